"""Helpers shared by the training-data operators: the cluster's shared folder, materialised
intermediate tables and a filesystem that Python workers can open."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only in local mode with that setting unset does the engine make a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
    return _OWN_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and the table
    outlives the loss of any executor. Returns the table and its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Rows that are turned into Python objects at a time: texts may be long. What a worker is sent at
#: once is bounded in bytes by spark.sql.execution.arrow.maxBytesPerBatch (64 MB by default).
SLICE_ROWS = 500


def slices(batches: Iterable) -> Iterator:
    """Arrow batches in parts of at most :data:`SLICE_ROWS` rows."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


#: Seconds between two collections of the driver's garbage: collections in a row count as a shortage
#: of memory, by which the JVM makes its heap larger, though little in it is alive.
COLLECT_EVERY = 10.0
_collected: dict[str, float] = {}


def drop_path(spark: SparkSession, *paths: str, collect: bool = True) -> None:
    """Delete materialised tables that nothing reads any more.

    The JVM is asked to collect its garbage then, at most once in :data:`COLLECT_EVERY` seconds: Spark
    deletes the shuffle files of finished jobs only when the driver finds their plans unreachable,
    which may take hours otherwise. Loops over small tables leave that to the next large one's end
    (``collect=False``)."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if collect and now - _collected.get(app, -COLLECT_EVERY) >= COLLECT_EVERY:
        _collected[app] = now
        jvm.System.gc()


def open_fs(uri: str):
    """(filesystem, path) of pyarrow for a URI of the shared folder (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def fold_of(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; the fold rule of the learning operators."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def unit_hash(*cols: Column) -> Column:
    """A reproducible number in (0, 1) from the columns' text, the same on every engine with md5."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return (head.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def row_blocks(df: DataFrame, rows_per_block: int) -> int:
    """How many blocks of about ``rows_per_block`` rows the table needs; grows with the table."""
    return max(1, -(-df.count() // rows_per_block))


#: Bytes table: A-Z to a-z, all else unchanged.
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
