"""What several corpus operators share: scratch tables and stable row keys."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import threading
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: While a scratch table is written: its shuffle files go when the write ends, and Python gets texts in small batches.
DURING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a new one only where that is unset, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lipikar-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths of the scratch tables of this process that are still there, oldest first.
_MADE: list[str] = []
_WRITES = threading.RLock()


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back, which cuts its lineage.

    Shuffle files of the write are of no use afterwards and go at once. The
    session's settings change during the write, so writes of several threads wait
    for one another. The table stays until ``drop_stored`` or ``clear_stored``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _WRITES:
        held = {k: spark.conf.get(k, None) for k in DURING}
        try:
            for k, v in DURING.items():
                spark.conf.set(k, v)
            writer.parquet(path)
        finally:
            for k, v in held.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        _MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _MADE:
            _MADE.remove(path)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes scratch tables that ``stored`` gave; nothing made from them may be read afterwards."""
    for t in tables:
        if (path := getattr(t, "stored_at", None)) in _MADE:
            _delete(t.sparkSession, [path])


def stored_so_far() -> int:
    return len(_MADE)


def clear_stored(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the scratch tables made after the first ``since``, but those in ``keep``: when results made from them have been written."""
    held = {getattr(t, "stored_at", None) for t in keep}
    _delete(spark, [p for p in _MADE[since:] if p not in held])


def kept(name: str) -> dict:
    """A dictionary that outlives tasks in a reused Python worker; this package itself travels with each task."""
    return sys.modules.setdefault("_lipikar_kept", types.ModuleType("_lipikar_kept")).__dict__.setdefault(name, {})


def unpickled(broadcast):
    """What a broadcast's pickle holds. The bytes are let go of, as an idle worker would keep them as long as it lives; the next task reads them again."""
    out = cloudpickle.loads(broadcast.value)
    if getattr(broadcast, "_path", None):
        broadcast.__dict__.pop("_value", None)
    return out


def give_back() -> None:
    """Hands memory that a task has freed back to the system: idle workers of earlier stages stay beside those of the next."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries do without
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for working columns that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
