"""Python functions work when the driver starts outside the repository."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["stem_vocabulary"](spark, sys.argv[2]).count())
spark.stop()
"""


def test_workers_find_the_package(tmp_path, sf_dir):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, REPO, sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "rows " in done.stdout, done.stderr[-3000:]
