"""Input tables and shared intermediate tables.

Everything goes through Spark's readers and writers, so a table may lie in any
store Spark can open.  Intermediate tables are written below the folder that
the cluster names in ``spark.checkpoint.dir``; it is shared by the driver and
all executors, so a lost executor loses none of them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The tables this process wrote: the frame that reads each, and its path.
_written: list[tuple[DataFrame, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder.  Only a local master, as in tests, gets one of its own; a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage and keeps a costly input from being computed once per use.
    The tables of a session are removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(clean_up)
    found = spark.read.schema(df.schema).parquet(path)
    _written.append((found, path))
    return found


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` returned; callers do so once no plan reads them."""
    for found, path in [x for x in _written if any(x[0] is t for t in tables)]:
        _remove(found.sparkSession, path)
    _written[:] = [x for x in _written if not any(x[0] is t for t in tables)]


def clean_up() -> None:
    """Remove every intermediate table this process wrote."""
    while _written:
        found, path = _written.pop()
        _remove(found.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: its shared folder is the cluster's to clean
        pass
