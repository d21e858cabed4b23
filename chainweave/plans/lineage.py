"""Where intermediate tables live and how lineage is cut.

Everything that must outlive an executor goes to the folder named by
``spark.checkpoint.dir``, which all machines of a cluster share. A session that
names none gets a temporary folder only where driver and executors are one
process (a ``local`` master); anywhere else that is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_open: list[str] = []  # folders of the surrounding ``scratch`` blocks


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; with a ``local`` master a temporary one where none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="chainweave-")
    return _own[app]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (eager): survives lost executors, forgets the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_open[-1] if _open else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside the block are deleted at its end: results must have been written elsewhere by then."""
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _open.append(folder)
    try:
        yield
    finally:
        _open.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder once and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
