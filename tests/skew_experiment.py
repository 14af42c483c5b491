"""Hot-stratum experiment: every label in one stratum; the naive per-stratum window vs
the bucketed fold assignment. Writes Spark's event log to a fresh scratch folder and
prints the longest task per plan.

    python tests/skew_experiment.py [sf_dir]
"""

import collections
import glob
import io
import json
import os
import sys
import tempfile
import time

import zstandard
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import SparkSession, functions as F, Window

EVD = tempfile.mkdtemp(prefix="glyphframe-eventlog-")
spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled","false")
         .config("spark.ui.showConsoleProgress","false")
         .config("spark.eventLog.enabled","true").config("spark.eventLog.dir", EVD)
         .config("spark.sql.shuffle.partitions","16").config("spark.sql.adaptive.enabled","true")
         .getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
from glyphframe.session import ensure_checkpoint_dir
ensure_checkpoint_dir(spark)
from glyphframe.plans import views as vw
from glyphframe.operators import folds as fo
sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
# every word in ONE stratum: the hot-key case
base = vw.ocr_words(spark, sf).select("row_id", F.lit(7).alias("length"))
spark.sparkContext.setJobGroup("naive", "naive")
w = Window.partitionBy("length").orderBy("row_id")
t0=time.time(); base.withColumn("rn", F.row_number().over(w)).write.format("noop").mode("overwrite").save(); t1=time.time()
spark.sparkContext.setJobGroup("bucketed", "bucketed")
fo.assign_folds(base, 5, bucket_rows=1<<17).write.format("noop").mode("overwrite").save(); t2=time.time()
print("naive", round(t1-t0,2), "bucketed", round(t2-t1,2))
spark.stop()

stage_group, durations = {}, collections.defaultdict(list)
for f in glob.glob(EVD + "/*/*events*"):
    raw = open(f, "rb").read()
    text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read().decode() if f.endswith(".zstd") else raw.decode()
    for line in text.splitlines():
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            for s_id in e["Stage IDs"]:
                stage_group[s_id] = e.get("Properties", {}).get("spark.jobGroup.id")
        elif e["Event"] == "SparkListenerTaskEnd":
            durations[e["Stage ID"]].append(e["Task Info"]["Finish Time"] - e["Task Info"]["Launch Time"])
for g in ("naive", "bucketed"):
    st = [(len(d), max(d)) for s_id, d in durations.items() if stage_group.get(s_id) == g]
    n, mx = max(st, key=lambda x: x[1])
    print(f"{g}: longest task {mx} ms, in a stage of {n} tasks")
