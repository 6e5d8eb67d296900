"""Session plumbing shared by the text operators: code shipping, Arrow batch bounds, durable cuts."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: No Arrow batch handed to Python holds more rows or bytes than this.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors and bound the Arrow batches.

    A session that already set the batch bounds keeps its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local session, as in tests, may lack it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark's setting to delete the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files every executor can read.

    All files of an application lie in one folder there, which can go when the application has ended.  ``forget`` deletes
    those of a frame that nothing reads any more.  The shuffle files of the job go with its end, for nobody reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomtab-{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    found = spark.read.schema(df.schema).parquet(path)
    found.cut_path = path
    return found


def forget(df: DataFrame) -> None:
    """Delete the files of a cut frame, once all that was made of it is cut too."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds about ``limit`` bytes a piece; a longer value stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(array: pa.Array):
    """(bytes as uint8, offsets) of a string or binary column; null counts as empty."""
    import numpy as np
    import pyarrow.compute as pc

    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = pc.fill_null(array, b"")
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def nullable(schema):
    """The schema with every column nullable."""
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField(f.name, f.dataType, True) for f in schema])


def whole_groups(batches, keys: int, rows: int, size: int = 1 << 20) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows or ``size`` bytes (the last may have fewer) that never cut a group.

    The input is sorted by its first ``keys`` columns; rows equal in all of them are a group.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    count = held_bytes = 0
    for whole in batches:
        # a batch is taken in parts, so that what is held is passed on soon
        step = max(1, whole.num_rows * size // max(whole.nbytes, 1) // 2)
        for batch in (whole.slice(k, step) for k in range(0, whole.num_rows, step)):
            if count < rows and held_bytes < size:
                held.append(batch)
                count += batch.num_rows
                held_bytes += batch.nbytes
                continue
            # what is held ends in a group that may go on: pass it on where the key changes
            tail = held[-1].slice(held[-1].num_rows - 1)
            same = np.ones(batch.num_rows, bool)
            for i in range(keys):
                same &= batch.column(i).to_numpy(zero_copy_only=False) == tail.column(i)[0].as_py()
            at = batch.num_rows if same.all() else int(np.argmin(same))
            if at:
                held.append(batch.slice(0, at))
            if at == batch.num_rows:
                continue
            yield pa.Table.from_batches(held)
            give_back()
            held = [batch.slice(at)]
            count, held_bytes = held[0].num_rows, held[0].nbytes
    if held:
        yield pa.Table.from_batches(held)


#: Ids that are sent to every executor at most; beyond it their rows are found by a shuffle join.
BROADCAST_IDS = 200_000


def rows_with(df: DataFrame, wanted: DataFrame, key: str | list[str]) -> DataFrame:
    """Inner join of ``df`` with ``wanted`` on ``key``: by broadcast if ``wanted`` is counted to be small."""
    from pyspark.sql import functions as F

    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return df.join(wanted, key)
