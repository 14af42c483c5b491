"""Chat formatting by a grammar round trip, in column functions only.

A rendered conversation is a row of turns of a small grammar::

    conversation = { turn }
    turn         = "<s>" ( "[SYS]" text "[/SYS]" | "[INST]" text "[/INST]" | "[OUT]" text "[/OUT]"
                         | "[ROLE]" role "[/ROLE]" text ) "</s>"

for system, user, assistant and any other role. Control strings begin with ``<`` or ``[`` and
hold neither anywhere else, so none can arise where a text meets its markers: only a text
itself can conflict with the grammar. The parser is deterministic: it cuts at ``</s>``, takes
the kind by the opening marker, and refuses bodies that hold a control string.

Each turn is rendered as it is, parsed back and compared with its source. Where the recovered
turn differs (a control string inside, or something that reads like an escaped one) the
turn is rendered with its content escaped, parsed and compared again; a turn that still
differed would be an error, never changed text. Escaping puts one backslash after
the bracket of every control string, escaped ones included (``[INST]`` to ``[\\INST]``,
``[\\INST]`` to ``[\\\\INST]``), and the parser takes one away, so nesting is kept.

Conversations are joined from their turns: ``formatted``, and ``mask`` with one entry per turn:
``at`` (where the turn begins), ``begin`` and ``end`` of the characters to learn, all in code
points from the beginning; turns that are not the assistant's have ``begin = end``.

Rendering and round trip go turn by turn and need no shuffle. A conversation is one
training example and one output row, so its rendered turns meet in one task; what does not
fit a string (2 GB) is an error.

Defined results: rows go by turn (null first), equal turns by role and text; a null text or role is
empty; a null conversation id is one conversation; repeated rows are turns of their own; other
columns play no part; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = {"system": "SYS", "user": "INST", "assistant": "OUT"}
LEARNED = "assistant"
END = "</s>"

_NAMES = "|".join([*KINDS.values(), "ROLE"])
_CONTROL = rf"(?:s>|(?:{_NAMES})\])"


def escaped(text: Column) -> Column:
    """One backslash more in every control string, plain or escaped."""
    return F.regexp_replace(text, rf"([<\[])(\\*/?{_CONTROL})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    """One backslash less in every escaped control string."""
    return F.regexp_replace(text, rf"([<\[])\\(\\*/?{_CONTROL})", "$1$2")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit("<s>[ROLE]"), role, F.lit("[/ROLE]"))
    for name, kind in KINDS.items():
        out = F.when(role == name, F.lit(f"<s>[{kind}]")).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(END)
    for name, kind in KINDS.items():
        out = F.when(role == name, F.lit(f"[/{kind}]{END}")).otherwise(out)
    return out


def rendered(role: Column, text: Column) -> Column:
    return F.concat(_opening(role), text, _closing(role))


def parse_piece(piece: Column) -> Column:
    """``struct<role, text>`` of what stands before one ``</s>``; null if it is no turn."""
    sound = lambda body: ~body.rlike(rf"[<\[]/?{_CONTROL}")
    turn = lambda role, body: F.struct(role.alias("role"), unescaped(body).alias("text"))
    start, stop = "<s>[ROLE]", "[/ROLE]"
    rest = F.substr(piece, F.lit(len(start) + 1))
    cut = F.locate(stop, rest)
    role, body = F.substr(rest, F.lit(1), cut - 1), F.substr(rest, cut + len(stop))
    out = F.when(piece.startswith(start) & (cut > 0) & sound(role) & sound(body), turn(unescaped(role), body))
    for name, kind in KINDS.items():
        start, stop = f"<s>[{kind}]", f"[/{kind}]"
        body = F.substr(piece, F.lit(len(start) + 1), F.length(piece) - len(start) - len(stop))
        out = F.when(piece.startswith(start) & piece.endswith(stop), F.when(sound(body), turn(F.lit(name), body))).otherwise(out)
    return out


def pieces(formatted: Column) -> Column:
    """What stands before each ``</s>``; the text after the last one comes last."""
    return F.split(formatted, END, -1)


def parse_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>``: the turns of rendered text. A text that does not end
    with a turn gives null, a part of it that is no turn a null entry."""
    cut = pieces(formatted)
    return F.when(formatted.endswith(END) | (formatted == ""), F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), parse_piece))


def render_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, segment, escaped``: every row with its rendered form, which
    parses back to exactly its role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    role, text = F.col("role"), F.col("text")

    def identical(segment: Column) -> Column:
        cut = pieces(segment)
        back = parse_piece(cut[0])
        return (F.size(cut) == 2) & (cut[1] == "") & back["role"].eqNullSafe(role) & back["text"].eqNullSafe(text)

    plain = rows.withColumn("plain", rendered(role, text))
    tried = plain.withColumn("escaped", ~identical(F.col("plain")))
    shut = F.when(role.isin(*KINDS), role).otherwise(escaped(role))
    done = tried.withColumn("segment", F.when(F.col("escaped"), rendered(shut, escaped(text))).otherwise(F.col("plain")))
    same = ~F.col("escaped") | identical(F.col("segment"))
    checked = F.when(same, F.col("segment")).otherwise(F.raise_error(F.lit("a rendered turn does not parse back to its source")))
    return done.select("conv", "turn", "role", "text", checked.alias("segment"), "escaped")


def format_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_col, formatted, mask``: one row per conversation."""
    turns = render_turns(conversations, conv_col, turn_col, role_col, text_col)
    before = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("segment").cast("long")
    head, tail = len(f"<s>[{KINDS[LEARNED]}]"), len(f"[/{KINDS[LEARNED]}]{END}")
    learned = F.col("role") == LEARNED
    placed = turns.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")))
    begin = F.col("at") + F.when(learned, head).otherwise(0)
    end = F.when(learned, F.col("at") + size - tail).otherwise(F.col("at"))
    span = F.struct(F.col("at"), begin.alias("begin"), end.alias("end"), F.col("segment"))
    whole = placed.select("conv", span.alias("span")).groupBy("conv").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    mask = F.transform("spans", lambda s: F.struct(s["at"].alias("at"), s["begin"].alias("begin"), s["end"].alias("end")))
    return whole.select(F.col("conv").alias(conv_col), F.array_join(F.col("spans.segment"), "").alias("formatted"), mask.alias("mask"))


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, read from the rendered text."""
    return F.array_join(F.zip_with(pieces(formatted), mask, lambda p, m: unescaped(F.substr(p, (m["begin"] - m["at"] + 1).cast("int"), (m["end"] - m["begin"]).cast("int")))), "")
