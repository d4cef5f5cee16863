"""What the corpus operators share: scratch tables in the cluster's shared folder and text batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one of our own if all runs on this machine; on a
    cluster that is refused, as its machines don't see each other's folders."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terrasift-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


#: Bytes of rows that a Python task is handed at once: an executor holds some batches of each task beside its heap.
BATCH_BYTES = 4 << 20


def lean(spark: SparkSession) -> None:
    """Let tasks be handed rows in batches of BATCH_BYTES, where the session's are larger; a longer row is a batch of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < set_to <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/terrasift/{what}-{uuid.uuid4().hex}"


def store(df: DataFrame, what: str, compression: str = "snappy", **options: str) -> tuple[DataFrame, str]:
    """Write df once as Parquet (with the writer's options) in the shared folder; lineage ends there. Returns it reread, and its path. What nobody
    removes before is deleted when the driver ends."""
    spark, path, schema = df.sparkSession, new_path(df.sparkSession, what), df.schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    lean(spark)
    df.write.option("compression", compression).options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path), path


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(columns: list[str], name: str) -> str:
    """name, or the first longer one that no column has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a column used inside a lambda may be worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary column; null is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def in_bytes(batch: pa.RecordBatch, column: str | int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about limit text bytes each, at least a row: long texts don't meet in one block of work."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


class Memory(dict):
    """What make() gave for a key, for `most` keys at most; then it begins anew."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


def give_back() -> None:
    """Hand what a task no longer needs back to the machine: a worker lives on for other tasks, and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library may not know it
        ctypes.CDLL(None).malloc_trim(0)


def hold_heap(trim: int = 256 << 20, mapped: int = 32 << 20) -> None:
    """Let this worker keep up to trim freed bytes until give_back(): arrays that live for a moment, over and over, would
    otherwise have their pages handed back and fetched again each time, which takes longer than to work them out."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        for what, n in ((-1, trim), (-3, mapped), (-2, 8 << 20)):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD, M_TOP_PAD
            libc.mallopt(what, n)


def tidy(run):
    """run, a function of a task's batches, with give_back() after the last."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def map_rows(df: DataFrame, run, **more: str) -> DataFrame:
    """df.mapInArrow(run) with df's columns, whatever their names (a dot or a name twice is no harm), and more columns
    (name: type) after them. run sees and gives columns by their places; it may use any names."""
    lean(df.sparkSession)
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    schema = StructType(list(plain.schema.fields))
    for i, kind in enumerate(more.values(), len(df.columns)):
        schema = schema.add(f"c{i}", kind)

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, schema.names)

    return plain.mapInArrow(tidy(renamed), schema).toDF(*df.columns, *more)


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Enough partitions that each has per_partition rows at most on average, and no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))
