"""Shared plumbing of the corpus operators: the shared work folder, eager tables, size-checked broadcasts.

Every intermediate table goes to the folder the cluster names in ``spark.checkpoint.dir``; a lost executor then
costs the tasks it ran, never a cached block.  Nothing here uses ``localCheckpoint``; a machine-local folder serves only
where none is set and the master is local, as in tests.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: bounds a batch of long texts (a few hundred texts of 100 kB stay under 60 MB).
ARROW_ROWS = 512
#: Bytes on disk up to which a written table may be broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 8 << 20
#: White space of the word contracts: space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_LOCAL: list[str] = []


def work_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="marketloom-"))
    return _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/marketloom/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: object) -> Iterator[None]:
    """Session settings for an eager step, put back afterwards (keys with ``__`` for ``.``)."""
    conf = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int | None = None) -> None:
    """Bound the Arrow batches of plans that are returned and run later, by rows and, where rows are large, by bytes."""
    spark.conf.set(_ROWS, str(rows))
    if size:
        spark.conf.set(_BYTES, str(size))


def save(df: DataFrame, name: str, rows: int = ARROW_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executors; shuffle files go at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, **{_CLEAN.replace(".", "__"): "true", _ROWS.replace(".", "__"): rows}):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marketloom_path = path
    return out


def table_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def drop(*frames: DataFrame) -> None:
    """Delete tables that ``save`` wrote, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._marketloom_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checked(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A saved table with a broadcast hint if its files are at most ``limit`` bytes; else as it is, for a shuffle."""
    return F.broadcast(df) if table_bytes(df.sparkSession, df._marketloom_path) <= limit else df


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores where a table already has such a column (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """Two-part content key: rows that share an id but not a text stay apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
