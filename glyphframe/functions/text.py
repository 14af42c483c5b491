"""Scalar text and path expressions (P1-P14). All are JVM-side Column expressions,
except the two general Unicode normal forms, which Spark lacks and which run as
Arrow-batched pandas UDFs. For Hangul both directions are syllable arithmetic
(``hangul_compose``, ``hangul_decompose``) and stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's.
DATA_PREFIX_FROM = "./"
DATA_PREFIX_TO = "./data/"
HANGUL_SYLLABLES = "가-힣"  # U+AC00 .. U+D7A3, the character class kept by cleaning
IGNORE_INDEX = -100
STAMP_FORMAT = "yyyy-MM-dd-HH-mm"
LEGACY_STAMP_FORMAT = "yyyy-HH-mm-ss"

# Unicode Hangul syllable arithmetic (from the Unicode standard, section 3.12).
S_BASE, L_BASE, V_BASE, T_BASE = 0xAC00, 0x1100, 0x1161, 0x11A7
L_COUNT, V_COUNT, T_COUNT = 19, 21, 28
N_COUNT = V_COUNT * T_COUNT  # 588
S_COUNT = 11172

# Strings made only of these characters are already NFC and decompose under NFKD by
# syllable arithmetic alone, so they never need the Python path.
_SIMPLE_CLASS = r"[\x00-\x7F가-힣]"
_SIMPLE_RE = rf"^{_SIMPLE_CLASS}*$"
# Jamo that join what stands before them.
_JOINING_RE = "[\u1161-\u1175\u11a8-\u11c2]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def char_from_code(cp) -> Column:
    """Character of a code point column (any plane), built with UTF-32 decoding."""
    return F.decode(F.unhex(F.lpad(F.hex(_c(cp).cast("bigint")), 8, "0")), "UTF-32")


def hex_of(code: Column) -> Column:
    """Eight hex digits of a code point, as ``text_of`` takes them."""
    return F.lpad(F.hex(code.cast("bigint")), 8, "0")


def text_of(hexes: Column) -> Column:
    """The text of an array of hex digits (``hex_of``, several together or none): decoded as a whole, after
    a byte-order mark, so that such a mark inside the text stays."""
    return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.array_join(hexes, ""))), "UTF-32")


def code_of(ch) -> Column:
    """Code point of the first character of a string column."""
    return F.ascii(_c(ch))


def chars(col) -> Column:
    """Array of the code points of a string, as one-character strings ([] for '';
    a plain ``split(s, '')`` gives [''] there)."""
    c = _c(col)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, ""))


def rewrite_path(col, old: str = DATA_PREFIX_FROM, new: str = DATA_PREFIX_TO) -> Column:
    """Literal replacement of every occurrence (not only a prefix)."""
    return F.replace(_c(col), F.lit(old), F.lit(new))


def label_length(col) -> Column:
    """Length in code points; null stays null."""
    return F.length(_c(col)).cast("int")


def clean_text(col, keep: str = HANGUL_SYLLABLES) -> Column:
    """Drop every character outside the class ``keep`` (a regex class body)."""
    return F.regexp_replace(_c(col), f"[^{keep}]", "")


def wrap_bos_eos(col, bos: str, eos: str) -> Column:
    """Begin and end tokens around the text."""
    return F.concat(F.lit(bos), _c(col), F.lit(eos))


def seq_probability(col) -> Column:
    """P10: log-score to probability."""
    return F.exp(_c(col))


def mask_to_pad(col, pad_id: int = 0, ignore_id: int = IGNORE_INDEX) -> Column:
    """Ignore id to pad id inside an id array."""
    return F.transform(_c(col), lambda x: F.when(x == F.lit(ignore_id), F.lit(pad_id)).otherwise(x))


def path_leaf(col) -> Column:
    """Last '/'-separated segment; empty for a trailing slash."""
    return F.element_at(F.split(_c(col), "/"), -1)


def run_stamp(ts, legacy: bool = False) -> Column:
    """File-name stamp of a timestamp column."""
    return F.date_format(_c(ts), LEGACY_STAMP_FORMAT if legacy else STAMP_FORMAT)


def hangul_decompose(col) -> Column:
    """NFKD of Hangul syllables by Unicode arithmetic; other characters pass unchanged.

    Exact NFKD for strings matching ``is_simple_text``.
    """

    def one(ch: Column) -> Column:
        code = code_of(ch)
        i = code - F.lit(S_BASE)
        lead = hex_of(F.lit(L_BASE) + F.floor(i / N_COUNT))
        vowel = hex_of(F.lit(V_BASE) + F.floor((i % N_COUNT) / T_COUNT))
        tail = F.when(i % T_COUNT > 0, hex_of(F.lit(T_BASE) + i % T_COUNT)).otherwise(F.lit(""))
        return F.when(i.between(0, S_COUNT - 1), F.concat(lead, vowel, tail)).otherwise(hex_of(code))

    c = _c(col)
    return F.when(c.rlike(f"[{HANGUL_SYLLABLES}]"), text_of(F.transform(chars(c), one))).otherwise(c)


def hangul_compose(col) -> Column:
    """NFC of conjoining jamo by Unicode arithmetic, in the JVM: a lead and the vowel after
    it make a syllable, a syllable without tail takes the tail after it; other characters
    pass unchanged. Hangul composes with nothing else, so this is all of NFC that can make
    or change a syllable, and all of NFC for text of ASCII, syllables and jamo.

    What a character becomes depends on its two neighbours on either side alone, so the codes are
    laid side by side with themselves shifted and each is mapped once; text without a vowel
    or tail jamo has nothing to compose and is passed on."""
    c = _c(col)
    codes = F.transform(chars(c), code_of)
    none = F.lit(0)
    sides = F.arrays_zip(
        codes.alias("c"),
        F.concat(F.array(none), codes).alias("p"),
        F.concat(F.array(none, none), codes).alias("q"),
        F.slice(F.concat(codes, F.array(none)), F.lit(2), F.length(c)).alias("n"),
        F.slice(F.concat(codes, F.array(none, none)), F.lit(3), F.length(c)).alias("m"),
    )
    lead = lambda x: x.between(L_BASE, L_BASE + L_COUNT - 1)
    vowel = lambda x: x.between(V_BASE, V_BASE + V_COUNT - 1)
    tail = lambda x: x.between(T_BASE + 1, T_BASE + T_COUNT - 1)
    open_syllable = lambda x: x.between(S_BASE, S_BASE + S_COUNT - 1) & ((x - F.lit(S_BASE)) % T_COUNT == 0)

    def one(x: Column) -> Column:
        taken = F.when(vowel(x["c"]), lead(x["p"])).when(tail(x["c"]), (vowel(x["p"]) & lead(x["q"])) | open_syllable(x["p"])).otherwise(False)
        begun = F.lit(S_BASE) + (x["c"] - L_BASE) * N_COUNT + (x["n"] - V_BASE) * T_COUNT
        code = (
            F.when(lead(x["c"]) & vowel(x["n"]), begun + F.when(tail(x["m"]), x["m"] - T_BASE).otherwise(0))
            .when(open_syllable(x["c"]) & tail(x["n"]), x["c"] + x["n"] - T_BASE)
            .otherwise(x["c"])
        )
        return F.when(x["c"].isNull() | taken, F.lit("")).otherwise(hex_of(code))

    return F.when(c.rlike(_JOINING_RE), text_of(F.transform(sides, one))).otherwise(c)


def is_simple_text(col) -> Column:
    return _c(col).rlike(_SIMPLE_RE)


def _normalizer(form: str):
    @F.pandas_udf(T.StringType())
    def normalize(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize(form, x))

    return normalize


_nfc_udf = _normalizer("NFC")
_nfkd_udf = _normalizer("NFKD")


def nfc(col) -> Column:
    """Unicode NFC. ASCII + precomposed-syllable strings are already NFC and skip
    Python; only the rest is shipped (other rows travel as nulls in the Arrow batch)."""
    c = _c(col)
    simple = is_simple_text(c)
    return F.when(simple | c.isNull(), c).otherwise(_nfc_udf(F.when(~simple, c)))


def nfkd(col) -> Column:
    """Unicode NFKD ("sub-character" labels). Hangul/ASCII strings are decomposed
    natively by syllable arithmetic; only other strings go through Python."""
    c = _c(col)
    simple = is_simple_text(c)
    return F.when(simple | c.isNull(), hangul_decompose(c)).otherwise(_nfkd_udf(F.when(~simple, c)))


def postprocess(col, keep: str = HANGUL_SYLLABLES) -> Column:
    """NFC then charset cleaning, in that order (jamo would be deleted otherwise). If only
    syllables are kept, composing jamo is all of NFC that matters, and no row goes to
    Python; another ``keep`` takes the general form."""
    return clean_text(hangul_compose(col) if keep == HANGUL_SYLLABLES else nfc(col), keep)
