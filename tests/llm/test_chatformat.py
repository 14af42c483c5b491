"""Chat formatting: exact round trips."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphframe.llm import chatformat as cf

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[\\INST]", "[SYS]", "[/OUT]", "<\\s>", "<\\\\/s>", "[ROLE]", "[/ROLE]", "\\", "[", "<", "]", ">", "/", "a", " ", "\n", "é", "\U0001f600", "s", "INST", "$1"]


def read_back(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = cf.format_conversations(df).cache()
    got = out.select("conv_id", "formatted", "mask", cf.parse_turns(F.col("formatted")).alias("turns"), cf.learned_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    return {r.conv_id: r for r in got}


def check(spark, rows):
    got = read_back(spark, rows)
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, mine in by.items():
        turns = [(role, text) for *_, role, text in sorted(mine)]
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == "".join(text for role, text in turns if role == "assistant")
        masked = "".join(got[c].formatted[m.begin : m.end] for m in got[c].mask)
        assert len(masked) == sum(m.end - m.begin for m in got[c].mask)
        assert got[c].formatted.count("</s>") == len(turns)


def test_round_trip_of_drawn_turns(spark):
    @given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]", "</s>", "us<\\s>er", None]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), min_size=60, max_size=120))
    @settings(max_examples=4, deadline=None)
    def run(drawn):
        check(spark, [(c, k, role, text) for k, (c, role, text) in enumerate(drawn)])

    run()


def test_only_conflicting_turns_are_escaped(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "plain [text] <b>"), (1, 2, "user", "[\\INST]")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.turn: r for r in cf.render_turns(df).collect()}
    assert [got[t].escaped for t in range(3)] == [True, False, True]
    assert got[0].segment == "<s>[INST]<\\/s>[\\INST] ok [\\/INST][/INST]</s>"
    assert got[1].segment == "<s>[OUT]plain [text] <b>[/OUT]</s>"
    assert got[2].segment == "<s>[INST][\\\\INST][/INST]</s>"


def test_awkward_rows(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", ""), (1, None, "assistant", "first"), (1, -1, "user", "x" * 500_000 + "</s>" + "\\" * 100_000), (2, 0, "user", "same"), (2, 0, "user", "same")]
    check(spark, rows)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", segment string, Conv string")
    assert cf.format_conversations(df).columns == ["conv_id", "formatted", "mask"]
    assert cf.format_conversations(df.where("false")).count() == 0
    bad = spark.createDataFrame([("<s>[INST]a[/INST]",), ("<s>[INST]a[SYS]b[/INST]</s>",), ("<s>[INST]a[/INST]</s>",), ("",)], "f string").select(cf.parse_turns(F.col("f")).alias("t")).collect()
    assert [r.t for r in bad] == [None, [None], [("user", "a")], []]


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)
    plan = cf.format_conversations(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_digest_columns(spark):
    from glyphframe.llm import queries

    rows = {r.conv_id: r for r in queries.QUERIES["op12_chat_format"](spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(said)
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert rows[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
