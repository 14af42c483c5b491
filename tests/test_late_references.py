"""References that arrive late: the final table equals the batch form, state stays bounded, late
rows are counted, a stopped run goes on."""

import random

import pytest
from pyspark.sql import functions as F

from glyphframe.operators import evaluate as ev
from glyphframe.streaming import late
from glyphframe.streaming import running as st

DAY, CLOSED = 86_400, 100_000
PRED, REF = "doc long, pred int, g string, ts timestamp", "doc long, label int, ts timestamp"


def write(spark, rows, schema, path):
    spark.createDataFrame([(*r[:-1], r[-1]) for r in rows], schema.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(path)


def arrive(spark, root, preds, refs, batches, after):
    """Rows ``(arrival, row)`` written as one file a batch, then a closing row each."""
    for rows, schema, name in ((preds, PRED, "p"), (refs, REF, "r")):
        for k in range(batches):
            if part := [r for a, r in rows if a == k]:
                write(spark, part, schema, f"{root}/{name}")
        if after is not None:
            one = spark.read.parquet(f"{root}/{name}")
            late.closing_row(one, "doc", "ts", F.timestamp_seconds(F.lit(after))).write.mode("append").parquet(f"{root}/{name}")


def attach(spark, root, delay, wait, path=None):
    p, r = (st.file_stream(spark, f"{root}/{n}", spark.read.parquet(f"{root}/{n}").schema) for n in "pr")
    joined = late.attach_references(p, r, "doc", "label", f"{delay} seconds", f"{wait} seconds")
    return late.run_attached(joined, "late-test", path)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def shuffled(spark):
    rng = random.Random(4)
    preds = [((i + rng.randrange(40)) // 100, (i if i % 50 else None, i % 2 if i % 9 else None, "ab"[i % 2], DAY + i)) for i in range(800)]
    refs = [((i + rng.randrange(80)) // 100, (i, i % 3 % 2, DAY + i + rng.randrange(-20, 20))) for i in range(0, 800, 3)]
    refs += [(4, (5000, 1, DAY + 400))]
    return preds, refs


def test_final_table_equals_batch(spark, tmp_dir, shuffled):
    preds, refs = shuffled
    arrive(spark, tmp_dir, preds, refs, 9, CLOSED)
    path, run = attach(spark, tmp_dir, 300, 30)
    table = late.read_attached(spark, path, closed_at=F.timestamp_seconds(F.lit(CLOSED)))
    p, r = (spark.read.parquet(f"{tmp_dir}/{n}").where(f"ts < timestamp_seconds({CLOSED})") for n in "pr")
    want = ev.optional_label_metrics(p, r.select("doc", "label"), "doc", "pred", "label", ["g"])
    got = ev.label_metrics(table, "pred", "label", ["g"])
    assert rows_of(got) == rows_of(want.select(*got.columns))
    assert run.late_rows == 0 and run.left_state_rows <= 2
    assert run.peak_state_rows < 0.8 * (len(preds) + len(refs)), "state held nearly everything"
    a = late.late_audit(p, r, table, "doc").first()
    assert (a.predictions, a.late_predictions, a.late_references) == (800, 0, 0)
    # document 0 of the references has only predictions with a null key, as have those of 150, 300 ...
    lone = sum(1 for _, (d, *_) in refs if d >= 800 or d % 50 == 0)
    assert a.orphan_references == lone and a.attached_references == len(refs) - lone


def test_late_rows_are_counted(spark, tmp_dir):
    preds = [(0, (1, 1, "a", 10)), (0, (2, 1, "a", 20)), (1, (3, 0, "a", 1000)), (2, (4, 1, "a", 1010)), (3, (9, 1, "a", 12))]
    refs = [(0, (1, 1, 12)), (1, (3, 0, 1000)), (2, (3, 0, 1001)), (3, (2, 1, 21)), (3, (77, 1, 1011))]
    arrive(spark, tmp_dir, preds, refs, 4, 9000)
    path, run = attach(spark, tmp_dir, 50, 30)
    table = late.read_attached(spark, path, closed_at=F.timestamp_seconds(F.lit(9000)))
    assert run.late_rows == 2, "prediction 9 and the reference of 2 came after the watermark"
    got = {(r.doc, r.label) for r in table.collect()}
    assert got == {(1, 1), (2, None), (3, 0), (4, None)}
    ends = [spark.read.parquet(f"{tmp_dir}/{n}").where("ts < timestamp_seconds(9000)") for n in "pr"]
    a = late.late_audit(*ends, table, "doc").first().asDict()
    assert a == {"predictions": 5, "references": 5, "late_predictions": 1, "attached_references": 3, "orphan_references": 1, "late_references": 1}


def test_goes_on_from_saved_state(spark, tmp_dir):
    root, path = f"{tmp_dir}/in", f"{tmp_dir}/out"
    arrive(spark, root, [(0, (1, 1, "a", 10)), (0, (2, 0, "b", 11))], [(0, (7, 1, 10))], 1, None)
    attach(spark, root, 100, 50, path)
    assert late.read_attached(spark, path).count() == 0 or {r.label for r in late.read_attached(spark, path).collect()} == {None}
    arrive(spark, root, [(0, (3, 1, "a", 30))], [(0, (1, 1, 20)), (0, (3, 0, 31))], 1, 5000)
    attach(spark, root, 100, 50, path)
    got = {(r.doc, r.pred, r.label) for r in late.read_attached(spark, path, closed_at=F.timestamp_seconds(F.lit(5000))).collect()}
    assert got == {(1, 1, 1), (2, 0, None), (3, 1, 0)}
