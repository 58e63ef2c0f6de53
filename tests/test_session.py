"""Intermediate tables without any setting of the machine."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from corpusflow import session

PLAIN = """
from corpusflow.session import local_session, scratch, shared_dir, written
spark = local_session("2", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
with scratch(spark):
    assert written(spark.range(5), "five").count() == 5
assert shared_dir(spark) == shared_dir(spark.newSession())
print("done", shared_dir(spark))
"""


def test_tables_are_written_without_a_configured_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_HOME", "PYSPARK_SUBMIT_ARGS")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).parent.parent)}
    out = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and "done /tmp/spark-corpusflow-" in out.stdout, out.stderr[-2000:]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
