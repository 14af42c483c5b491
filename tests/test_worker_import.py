"""UDF code reaches Python workers even when the package is not importable there
(driver started outside the repository, package not installed)."""

import os
import subprocess
import sys
import tempfile

from conftest import SF001

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as E
for k in ["per_batch_transform", "nfc_compose", "batch_predict"]:
    print(k, E.queries()[k](spark, {sf!r}).count())
"""


def test_udfs_run_without_package_on_workers():
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    cwd = tempfile.mkdtemp(prefix="glyphframe-elsewhere-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo, sf=SF001)], cwd=cwd, env=env, capture_output=True, text=True, timeout=600
    )
    lines = dict(l.split() for l in out.stdout.splitlines() if l.count(" ") == 1)
    assert set(lines) == {"per_batch_transform", "nfc_compose", "batch_predict"}, out.stderr[-1500:]
    assert all(int(v) > 0 for v in lines.values())
