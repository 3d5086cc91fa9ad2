"""The package reaches Python workers of a session that was started elsewhere."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
CODE = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
print("ROWS", entry.queries()["F1_indel_ratio"](spark, "/root/testdata/sf0.001").count())
"""


def test_another_folder(spark, tmp_path):
    want = entry.queries()["F1_indel_ratio"](spark, "/root/testdata/sf0.001").count()
    assert want > 0
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert f"ROWS {want}\n" in out.stdout, out.stderr[-2000:]
