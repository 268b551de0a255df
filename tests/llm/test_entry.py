"""Queries run in workers that cannot import this repository: started from elsewhere, without PYTHONPATH."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import importlib.util, sys
from pyspark.sql import SparkSession

found = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(found)
found.loader.exec_module(entry)
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
spark = spark.config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
names = [n for n in entry.queries() if n == "pipeline" or n.startswith("op") and n[2].isdigit()]
assert len(names) >= 14, names
for name in names:
    entry.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
"""


def test_workers_without_the_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", RUN, ROOT, str(tmp_path / "scratch")], cwd=tmp_path, env=env, check=True)
