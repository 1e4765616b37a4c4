"""The library and its entry stand without the subpackage on training text."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from recallspark.session import cleared, new_folder, shared_dir

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    assert (copy / "corpus_pipeline.py").exists()
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert len(q) > 100 and not any(n == 'pipeline' or n.startswith('op') and n[2:3].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = os.environ | {"PYTHONPATH": os.pathsep.join(filter(None, [str(copy), os.environ.get("PYTHONPATH")]))}
    for lost in ((), ("corpus_pipeline.py",)):
        for name in lost:
            (copy / name).unlink()
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
    done = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout


def test_cleared_deletes_what_was_made_inside(spark):
    outer = new_folder(spark, "kept")
    spark.range(3).write.parquet(outer)
    with cleared(spark):
        inner = new_folder(spark, "gone")
        spark.range(3).write.parquet(inner)
    assert spark.read.parquet(outer).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(inner)


def test_queries_run_where_no_folder_is_set(tmp_path):
    """A session of its own, without defaults: it can't be told a checkpoint folder once it runs."""
    code = """
from recallspark.session import CHECKPOINT_DIR, local_session, shared_dir
spark = local_session(2, 2)
assert spark.conf.get(CHECKPOINT_DIR, None) is None
assert shared_dir(spark) == shared_dir(spark)
import __spark_entry__ as e
for name in ("hybrid_search", "op9_simhash"):
    if name in e.queries():
        assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
"""
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Cluster:
        conf = Conf({"spark.sql.warehouse.dir": "file:/opt/warehouse"})
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="share"):
        shared_dir(Cluster)
    Cluster.conf["spark.sql.warehouse.dir"] = "hdfs://names/warehouse"
    assert shared_dir(Cluster) == "hdfs://names/warehouse/_recallspark"
    Cluster.conf["spark.checkpoint.dir"] = "file:/shared/place"
    assert shared_dir(Cluster) == "file:/shared/place"
