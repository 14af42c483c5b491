"""Licence scan: Aho-Corasick over the words of a text, shunting-yard over the licence
expressions that its identifier tags carry.

The automaton runs over the normal form of ``kernels.WordStream``, so a phrase is found
wherever its words stand consecutively, whatever stands between them. Three kinds of phrase:

* base phrases, each with a label; every place counts;
* notice phrases, which name a licence in a longer form (title or wording of the grant); of
  those that begin at one place the longest counts;
* identifier tags, after which an expression such as ``MIT OR (Apache-2.0 WITH x AND GPL)``
  is read from the original text. A shunting-yard parser turns it into postfix order, and
  its evaluation gives the identifiers required (``and``) and offered (``or``).

Labels are the base labels, the notice labels and the licence families of the identifiers. An
identifier of no known family is a label only if it looks like one (``LicenseRef-``, or a
version in it), as prose may follow a tag.
The score is 1 minus the product of (1 - weight) over the distinct kinds of evidence.

Defined results: a null or empty text has 0 words, no places, empty label strings, null
first and last word and score 0; a malformed expression gives the identifiers it names and
``valid`` false.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.graph import text_session
from glyphframe.llm.kernels import WordStream, text_chunks

# Base phrases with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notice phrases (words in normal form) and their labels.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "apache license version 2": "apache",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "creative commons attribution": "cc",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by": "cc-by",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
# Identifier tags in normal form.
IDENTIFIER_TAGS = ("spdx license identifier", "license identifier")
# Licence families by the beginning of an identifier; the longest fits.
FAMILIES = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "bsd": "bsd", "isc": "isc", "cc0": "public-domain", "cc-by-nc": "cc-by-nc", "cc-by": "cc-by", "unlicense": "public-domain"}
BASE_WEIGHT, NOTICE_WEIGHT, TAG_WEIGHT = 0.7, 0.6, 0.95

_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*")
_OPERATORS = {"or": 1, "and": 2, "with": 3}
# Between the words of a tag stands whatever separates words.
_TAG_TEXT = re.compile(r"license[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+identifier\s*[:=]?[ \t]*([^\r\n*<]*)", re.IGNORECASE)

RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, "
    "notices array<string>, expressions array<struct<text:string,postfix:string,required:array<string>,offered:array<string>,valid:boolean>>"
)

_TEXTS = pa.list_(pa.string())
ARROW = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": _TEXTS, "labels": _TEXTS, "score": pa.float64(), "notices": _TEXTS,
    "expressions": pa.list_(pa.struct([("text", pa.string()), ("postfix", pa.string()), ("required", _TEXTS), ("offered", _TEXTS), ("valid", pa.bool_())])),
}


def postfix(expression: str) -> tuple[list[str], bool]:
    """Shunting-yard: tokens in postfix order, and whether the expression is well formed.
    ``with`` binds tightest, then ``and``, then ``or``; all are left-associative. Reading
    ends at the first word that can't continue the expression."""
    out: list[str] = []
    stack: list[str] = []
    expect, valid = True, True
    for token in _TOKEN.findall(expression):
        op = token.lower()
        if op in _OPERATORS:
            if expect:
                valid = False
                continue
            while stack and stack[-1] != "(" and _OPERATORS[stack[-1]] >= _OPERATORS[op]:
                out.append(stack.pop())
            stack.append(op)
            expect = True
        elif token == "(":
            if not expect:
                break
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif expect:
            out.append(token)
            expect = False
        else:
            break
    if expect and out:
        valid = False
    while stack:
        top = stack.pop()
        if top == "(":
            valid = False
        else:
            out.append(top)
    return out, valid and bool(out)


def evaluate(tokens: list[str]) -> tuple[frozenset[str], frozenset[str]]:
    """``(required, offered)`` of a postfix expression: ``and`` unites both sides, ``or``
    requires what both sides require and offers the rest; an exception after ``with`` is
    not a licence of its own."""
    stack: list[tuple[frozenset, frozenset]] = []
    for t in tokens:
        if t in _OPERATORS:
            if len(stack) < 2:
                continue
            (r2, o2), (r1, o1) = stack.pop(), stack.pop()
            if t == "with":
                stack.append((r1, o1))
            elif t == "and":
                stack.append((r1 | r2, o1 | o2))
            else:
                stack.append((r1 & r2, o1 | o2))
        else:
            one = frozenset([t.lower()])
            stack.append((one, one))
    required = frozenset().union(*(r for r, _ in stack))
    return required, frozenset().union(*(o for _, o in stack))


def family(identifier: str) -> str | None:
    """Licence family of an identifier; one of no known family is its own, or none if it does
    not look like an identifier."""
    found = max((f for f in FAMILIES if identifier.startswith(f)), key=len, default=None)
    if found:
        return FAMILIES[found]
    return identifier if identifier.startswith("licenseref-") or any(c.isdigit() for c in identifier) else None


def automaton():
    """Aho-Corasick automaton over all phrases, each followed by a space."""
    import ahocorasick

    kinds: dict[str, list] = {}
    for p, label in BASE_PHRASES.items():
        kinds.setdefault(p, []).append(("base", label))
    for p, label in NOTICE_PHRASES.items():
        kinds.setdefault(p, []).append(("notice", label))
    for p in IDENTIFIER_TAGS:
        kinds.setdefault(p, []).append(("tag", p))
    a = ahocorasick.Automaton()
    for p, what in kinds.items():
        a.add_word(f"{p} ", (len(p) + 1, what))
    a.make_automaton()
    return a


def expressions(text: str) -> list[dict]:
    """The licence expressions after identifier tags of an original text."""
    out = []
    for m in _TAG_TEXT.finditer(text):
        tokens, valid = postfix(m[1])
        if tokens:
            required, offered = evaluate(tokens)
            out.append({"text": m[1].strip(), "postfix": " ".join(tokens), "required": sorted(required), "offered": sorted(offered), "valid": valid})
    return out


def scan(column: pa.Array, auto) -> dict[str, list]:
    n = len(column)
    n_words = np.zeros(n, np.int64)
    base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    longest: list[dict[int, tuple[int, str]]] = [{} for _ in range(n)]  # notices by place
    tagged: set[int] = set()
    for a, b, raw, ends in text_chunks(column):
        ws = WordStream(raw, ends)
        n_words[a:b] = ws.n_words
        # Latin-1 keeps one character per byte, so places are byte offsets.
        flat = ws.data.tobytes()
        places = [(end - size + 1, size, what) for end, (size, what) in auto.iter(flat.decode("latin-1"))]
        places = [(p, size, what) for p, size, what in places if p == 0 or flat[p - 1] <= 32]
        if not places:
            continue
        numbers = np.searchsorted(ws.starts, [p for p, *_ in places])
        docs = np.searchsorted(ws.first, numbers, side="right") - 1
        for (_, size, what), word, d in zip(places, numbers.tolist(), docs.tolist(), strict=True):
            for kind, label in what:
                if kind == "base":
                    base[a + d].append((word - int(ws.first[d]), label))
                elif kind == "notice":
                    longest[a + d][word] = max(longest[a + d].get(word, (0, "")), (size, label))
                else:
                    tagged.add(a + d)
    notices = [{label for _, label in x.values()} for x in longest]
    exprs: list[list[dict]] = [[] for _ in range(n)]
    for i in tagged:
        exprs[i] = expressions(column[i].as_py())
    out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices", "expressions")}
    for i in range(n):
        words = [w for w, _ in base[i]]
        base_labels = sorted({x for _, x in base[i]})
        named = {family(x) for e in exprs[i] for x in e["offered"]} - {None}
        doubt = (1 - BASE_WEIGHT) ** len(base_labels) * (1 - NOTICE_WEIGHT) ** len(notices[i]) * ((1 - TAG_WEIGHT) if exprs[i] else 1.0)
        row = (int(n_words[i]), len(words), min(words, default=None), max(words, default=None), base_labels, sorted({*base_labels, *notices[i], *named}), 1.0 - doubt, sorted(notices[i]), exprs[i])
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
    return out


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, places of base phrases, labels, score, notice labels and
    the parsed licence expressions (see the module docstring)."""
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text" if id_col == "text" else "text"))
    id_type = rows.schema[0].dataType.simpleString()
    text_session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for batch in batches:
            got = scan(batch.column(1), auto)
            arrays = [batch.column(0), *(pa.array(got[c], kind) for c, kind in ARROW.items())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *ARROW])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, {RESULT}")
