"""The driver's contract, from a process whose workers find the package by nothing but what is sent to them."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no tables")
def test_entry_from_another_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
import __spark_entry__ as e
print('ROWS', e.entry(spark).count(), e.queries()['poet_centroids'](spark, '/root/testdata/sf0.001').count(), set(e.oracle_sql()) <= set(e.queries()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    words = out.stdout.rpartition("ROWS")[2].split()
    assert words and int(words[0]) > 0 and int(words[1]) > 0 and words[2] == "True", out.stderr[-2000:]
