"""The folder that driver and executors share, and tables kept there for a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_KEPT: dict[tuple[str, ...], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only local mode without that setting makes a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    return _LOCAL[app]


def session_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application's own tables go to."""
    return f"{shared_dir(spark)}/corpusmill-{spark.sparkContext.applicationId}"


def _path(spark: SparkSession, uri: str):
    """(filesystem, path) of Hadoop for a URI."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has written for itself; results that still read them
    can be read no more."""
    fs, p = _path(spark, session_dir(spark))
    fs.delete(p, True)
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        del _KEPT[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: its lineage ends there."""
    path = f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def files_of(df: DataFrame) -> tuple[str, ...]:
    """The input files of a table with their sizes and times: what tells whether a stored result of
    it still holds."""
    spark = df.sparkSession
    out = []
    for name in sorted(df.inputFiles()):
        fs, p = _path(spark, name)
        s = fs.getFileStatus(p)
        out.append(f"{name}|{s.getLen()}|{s.getModificationTime()}")
    return tuple(out)


def kept(spark: SparkSession, name: str, source: DataFrame, write: Callable[[str], None]) -> str:
    """The path of what ``write`` stores for these input files; written once in a session, and again if
    it has gone."""
    key = (spark.sparkContext.applicationId, name, *files_of(source))
    if key in _KEPT:
        fs, p = _path(spark, _KEPT[key])
        if fs.exists(p):
            return _KEPT[key]
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write(path)
    _KEPT[key] = path
    return path
