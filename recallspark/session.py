"""Session settings, and written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

#: Where the folder is kept in a session that was started without ``CHECKPOINT_DIR``, which cannot be set later.
OWN_DIR = "recallspark.shared.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches: UTC, adaptive execution, few shuffle partitions."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("recallspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a local master, whose tasks are all in one process, gets a temporary folder, kept in
    the session's settings; a cluster uses its warehouse, if that is a place that all its machines reach.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get(OWN_DIR, None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_recallspark"
        if found.startswith(("file:", "/")):
            raise ValueError(f"set {CHECKPOINT_DIR}: a cluster's machines do not share {found}")
    spark.conf.set(OWN_DIR, found)
    return found


#: Folders made inside ``cleared``, innermost last.
_made: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all folders that were made inside it: for steps whose result was written elsewhere."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            deleted(spark, path)


#: Shuffle partitions that one task of ``packed`` takes at most, where there are cores enough.
PARTITIONS_A_TASK = 16


def packed(df: DataFrame) -> DataFrame:
    """``df`` in two partitions a core, or one for ``PARTITIONS_A_TASK`` of the session's, if these are more; rows are not moved.

    For tables that are written: each task makes a file, and for a file on a local disk the JVM starts processes that
    stand in its memory a second time until their program is loaded. Order within a table is not kept.
    """
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // PARTITIONS_A_TASK))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors. ``options`` are the writer's."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        deleted(spark, path)
