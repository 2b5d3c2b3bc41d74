"""Sessions with and without a shared folder, each in a process of its own."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
{before}
from lexicask.plans import catalogue
found = catalogue.stored_lookup(spark, "/root/testdata/sf0.001").count()
print("FOUND", found, catalogue.work_dir(spark))
"""


@pytest.mark.parametrize("before", ["", "spark.sparkContext.setCheckpointDir('{tmp}/own')"])
def test_a_session_without_the_setting(tmp_path, before):
    (tmp_path / "conf").mkdir()  # an empty configuration folder, so that nothing sets spark.checkpoint.dir
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": ROOT, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE.format(before=before.format(tmp=tmp_path))], env=env, capture_output=True, text=True, timeout=200)
    said = next(x for x in done.stdout.splitlines() if x.startswith("FOUND")).split()
    assert int(said[1]) > 50 and str(tmp_path) in said[2] and ("/own/" in said[2]) == bool(before)
