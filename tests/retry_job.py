"""Run in its own process by test_retries.py: every task of a stage fails on its first
attempt (as when an executor is lost) and is retried; results must equal a clean run."""

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sf = sys.argv[1]
ckpt = tempfile.mkdtemp(prefix="glyphframe-retry-")
marks = tempfile.mkdtemp(prefix="glyphframe-retry-marks-")
spark = (
    SparkSession.builder.master("local[4,4]")  # up to 4 attempts per task
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.shuffle.partitions", "8")
    .config("spark.checkpoint.dir", ckpt)
    .getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
spark.sparkContext.setCheckpointDir(ckpt)

from glyphframe.operators import folds as fo  # noqa: E402
from glyphframe.sources import files as fi  # noqa: E402
from glyphframe.plans import views as vw  # noqa: E402


@F.pandas_udf("string")
def flaky(s: pd.Series) -> pd.Series:
    tc = TaskContext.get()
    if tc.attemptNumber() == 0:
        open(os.path.join(marks, f"{tc.stageId()}-{tc.partitionId()}-{tc.taskAttemptId()}"), "w").close()
        raise RuntimeError("simulated lost task")
    return s


def run(with_failures: bool):
    words = vw.ocr_words(spark, sf)
    if with_failures:
        words = words.withColumn("label", flaky("label"))
    folds = fo.assign_folds(fo.long_labels(fo.prepare_labels(words)), 5, bucket_rows=4096)
    f = sorted((r.row_id, r.fold) for r in folds.select("row_id", "fold").collect())
    csv_dir = os.path.join(ckpt, "csv")
    if not os.path.exists(csv_dir):
        vw.ocr_words(spark, sf).orderBy("row_id").select("img_path", "label").repartition(3).write.option("header", True).option("escape", '"').csv(csv_dir)
    scanned = fi.scan_label_csv(spark, csv_dir)
    if with_failures:
        scanned = scanned.withColumn("img_path", flaky("img_path"))
    idx = sorted((r.row_id, r.img_path) for r in scanned.select("row_id", "img_path").collect())
    return f, idx


clean = run(False)
failing = run(True)
print(json.dumps({"folds_equal": clean[0] == failing[0], "index_equal": clean[1] == failing[1], "n": len(clean[0]),
                  "failed_attempts": len(os.listdir(marks))}))
spark.stop()
