"""Operators in a session that names no checkpoint folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
from pyspark.sql import SparkSession
from gleanery.llm import store, vector_dedup
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
rows = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.1], 1), (3, None, 1)], "vec_id long, embedding array<float>, label int")
print("found", sorted((r.vec_id, r.component_id) for r in vector_dedup.groups(rows).collect()), store.shared_dir(spark).startswith("file:///"))
"""


def test_operators_start_without_a_checkpoint_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT, "TMPDIR": str(tmp_path)}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    out = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "found [(1, 1), (2, 1), (3, 3)] True" in out.stdout, out.stderr[-2000:]
    assert not [x for x in os.listdir(tmp_path) if x.startswith("gleanery-")]
