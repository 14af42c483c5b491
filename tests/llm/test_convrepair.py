"""Conversation repair against an exhaustive search, whatever the chunks."""

import hashlib
import heapq
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphframe.llm import convrepair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def best_edits(rows):
    """Cheapest, then ASCII-least edits by a uniform-cost search over (row, initials so far)."""
    heap, done = [(0, "", 0, "start", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("start", "a"):
            return cost, audit, out
        need = {"start": "u", "s": "u", "u": "a", "a": "u"}[state]
        name = {"u": "user", "a": "assistant"}[need]
        steps = [("I", 5, i, need, (f"{name}:",))]
        if i < len(rows):
            role, text, must, cut = rows[i]
            steps.append(("D", 2, i + 1, state, ()))
            if not must:
                if role[:1] == need or state == "start" and role[:1] == "s":
                    steps.append(("K", cut, i + 1, role[:1], (f"{role}:{text}",)))
                steps.append(("R", 1 + cut, i + 1, need, (f"{name}:{text}",)))
        for letter, c, j, to, more in steps:
            heapq.heappush(heap, (cost + c, audit + letter, j, to, out + more))
    raise AssertionError


def brute(rows):
    """Summary of one conversation's (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), 5 * (fault == "truncated")))
    cost, audit, out = best_edits(marked)
    told = [t for t, _, _ in rows if t is not None]
    gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def drawn(seed, convs, most):
    rng = random.Random(seed)
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "super"])
            text = rng.choice(["Yes.", "No", f"words {t}.", f"words {t}", " \t", "", "again!", "é?\n"])
            out.append((c if c else None, rng.choice([t, t, t, t + 3, None]), role, text))
    return out


@pytest.mark.parametrize("chunk, longest", [(1, 14), (3, 40), (4096, 300)])
def test_equals_exhaustive_search(spark, chunk, longest):
    rows = drawn(chunk, 60, 14) + drawn(7, 2, longest)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role, text))
    got = {r[0]: tuple(r)[1:] for r in cr.repair_conversations(df, max_rows=chunk).collect()}
    assert got == {c: brute(rs) for c, rs in by.items()}


def test_repaired_turns_are_sound(spark):
    rows = drawn(3, 40, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    out = cr.repaired_turns(df, max_rows=2).orderBy("conv_id", "place").collect()
    sums = {r.conv_id: r for r in cr.repair_conversations(df).collect()}
    bodies, audits = {}, {}
    for r in out:
        bodies.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        audits[r.conv_id] = audits.get(r.conv_id, "") + r.edit
    for c, s in sums.items():
        assert s.repaired_sha256 == hashlib.sha256("\n".join(bodies.get(c, [])).encode()).hexdigest()
        assert s.audit.replace("D", "") == audits.get(c, "")
        assert re.fullmatch("(s?(ua)+)?", "".join(b[:1] for b in bodies.get(c, [])))


@given(st.lists(st.integers(0, 7), max_size=30), st.lists(st.integers(0, 9), min_size=4, max_size=4))
@settings(max_examples=200, deadline=None)
def test_fix_up_equals_rerun(codes, more):
    other = cr._with_inserts(list(more))
    other = tuple(c - min(other) for c in other)
    assert cr.fix_up(codes, cr.END, cr.backward(codes, cr.END), other) == cr.backward(codes, other)


def test_awkward_rows(spark):
    rows = [(None, None, None, None), (1, None, "user", "a."), (1, 0, "user", "b."), (1, 0, "assistant", "c."), (2, 5, "assistant", "x" * 300_000)] + [(3, 1, "user", "same.")] * 500
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA + ", code string, m long, Conv string")
    by = {r.conv_id: r for r in cr.repair_conversations(df).collect()}
    assert (by[None].blank, by[None].cost, by[None].audit) == (1, 2, "D")
    assert by[1].audit == "KKD" and by[1].illegal == 0 and by[1].gaps == 0
    assert by[2].audit == "D" and by[2].truncated == 1
    assert by[3].duplicate == 499 and by[3].audit == "K" + "D" * 499 + "I" or by[3].audit == "D" * 500
    assert by[3].illegal == 499 and by[3].cost == min(499 * 2 + 5, 1000)
    assert cr.repair_conversations(df.where("false")).count() == 0
    zero = cr.repair_conversations(df.withColumn("m", F.when(F.col("conv_id") == 1, 0).otherwise(1)), copies=F.col("m"))
    got = {r.conv_id: r for r in zero.collect()}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and got[2].audit == "D"


def test_one_hot_conversation(spark):
    """One conversation with most rows, cut into many chunks over many tasks."""
    rows = [(1, t, ["user", "assistant", "assistant"][t % 3] if t % 7 else "user", f"turn {t // 2}" + "." * (t % 5 > 0)) for t in range(3000)]
    df = spark.createDataFrame(rows + [(2, 0, "user", "q?"), (2, 1, "assistant", "a.")], SCHEMA).repartition(8)
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair_conversations(df, max_rows=64).collect()}
    assert got[1] == brute([r[1:] for r in rows]) and got[2][6] == "KK"
