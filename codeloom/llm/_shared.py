"""What the operators share: the shared folder, text batches and bounded caches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of text, handled at once inside an Arrow batch; a single longer text is handled alone. Bounds a worker's memory.
STEP, STEP_BYTES = 1024, 2 << 20
#: Bytes of an Arrow batch on its way to a worker, unless the session says less; bounds the buffers outside the executor's heap.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    Only where it is unset, as in local tests, a temporary folder takes its place; a cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table over all cores where it has no more than half as many partitions, as a small one in one row group does. Larger
    ones stay as they are, so nothing of them is shuffled."""
    docs, wanted = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return docs.repartition(wanted) if 2 * docs.rdd.getNumPartitions() <= wanted else docs


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows go to the workers in batches of about BATCH_BYTES; Spark's own limit counts rows, whatever their length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where slices of at most STEP rows and about STEP_BYTES begin, and their lengths."""
    at = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > at and (size + n > STEP_BYTES or i - at == STEP):
            yield at, i - at
            at, size = i, 0
        size += n
    if len(texts) > at:
        yield at, len(texts) - at


def _give_back() -> None:
    """Returns freed memory to the system: workers live on from task to task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(docs: DataFrame, schema: str, make: Callable, *extra: str, arrow: bool = False) -> DataFrame:
    """One pass over doc_id, text and extra columns.

    make() runs once per task and gives f(columns) -> dict of lists or arrays by output column; columns are Python lists (Arrow
    arrays if arrow), null texts stay None. Other columns of docs are not read.
    """
    rows = docs.select("doc_id", "text", *extra)
    out = docs.sparkSession.createDataFrame([], schema).schema
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        f = make()
        try:
            for batch in batches:
                for at, n in _steps(batch.column(1)):
                    columns = batch.slice(at, n).columns
                    got = f(*(columns if arrow else [c.to_pylist() for c in columns]))
                    if got is not None:
                        yield pa.RecordBatch.from_arrays([got[n].cast(kinds.field(n).type) if isinstance(got[n], pa.Array) else pa.array(got[n], kinds.field(n).type, from_pandas=False) for n in names], schema=kinds)
        finally:
            del f
            _give_back()

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, out)


def map_slices(docs: DataFrame, schema, f: Callable, place: int) -> DataFrame:
    """f(slice) -> record batch, over slices of all columns, bounded by rows and by bytes of the text in column `place`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for at, n in _steps(batch.column(place)):
                    yield f(batch.slice(at, n))
        finally:
            _give_back()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def selected(docs: DataFrame, make: Callable) -> DataFrame:
    """The rows of docs, with all their columns, that f = make() (once per task) keeps: f(texts) -> booleans. Each row is judged by
    itself, so null and repeated doc_ids are no matter, and nothing is shuffled."""
    names, place = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text")
    plain, held = docs.toDF(*names), []

    def keep(part: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(make())
        return part.filter(pa.array(held[0](part.column(place).to_pylist()), pa.bool_()))

    return map_slices(plain, plain.schema, keep, place).toDF(*docs.columns)


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column without copying: value i is data[bounds[i] : bounds[i + 1]]."""
    places = (bounds * data.itemsize).astype(np.int32 if len(data) * data.itemsize < 1 << 31 else np.int64)
    kind = pa.binary() if places.dtype == np.int32 else pa.large_binary()
    return pa.Array.from_buffers(kind, len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))])


def values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A binary column without nulls as numbers of this kind, all values one after the other, and the bounds of each."""
    wide = pa.types.is_large_binary(column.type)
    _, places, body = column.buffers()
    bounds = np.frombuffer(places, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    size = np.dtype(kind).itemsize
    raw = body[int(bounds[0]) : int(bounds[-1])] if body is not None else b""
    return np.frombuffer(raw, kind), (bounds - bounds[0]) // size


class Cache(dict):
    """A dict that computes missing values one by one and starts anew when it is full; limit bounds its memory."""

    def __init__(self, make: Callable, limit: int = 250_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.make(key)
        return value


def share(column: str, top: int = 1 << 20):
    """A number from 0 to 1 that depends on the key alone: the same rows are sampled at every run and partitioning."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(top)) / F.lit(float(top))
