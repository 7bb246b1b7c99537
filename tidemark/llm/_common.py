"""Helpers shared by the training-data operators: Arrow slices, ragged arrays, scratch tables, bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import shared_folder

#: Texts are worked on in slices of about so many bytes, so that temporaries stay small whatever the batch holds.
SLICE_BYTES = 4 << 20
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2500
#: No more labelled rows than this are used to fit a model.
MAX_TRAIN_ROWS = 20_000


def bounded_batches(spark: SparkSession, most: int = BATCH_ROWS) -> None:
    """Python workers get at most `most` rows at once: whole texts may be long, and executors small."""
    if int(spark.conf.get(BATCH_CONF)) > most:
        spark.conf.set(BATCH_CONF, str(most))


def released(batches: Iterator) -> Iterator:
    """The batches; then what the worker no longer uses goes back to the system, as Spark keeps idle workers for later tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_scratch: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Strings without nulls (null: empty), in one array with 64-bit offsets."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pc.fill_null(array.cast(pa.large_string()), "")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of rows of at most `most` bytes, or of one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield texts.slice(at, stop - at)
        at, done = stop, int(ends[stop - 1])


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of every text: index into the distinct words, the distinct words, the texts' offsets."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    rows = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    flat = pc.list_flatten(lists).dictionary_encode()
    index, vocab = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
    if len(empty := np.flatnonzero(pc.binary_length(vocab).to_numpy(zero_copy_only=False) == 0)):
        keep = index != empty[0]
        index, rows = index[keep], rows[keep]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=len(texts)), out=offsets[1:])
    return index, vocab, offsets


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the concatenation of ranges [start, start + length)."""
    total = int(lengths.sum())
    kind = np.int32 if max(total, int(np.max(starts + lengths, initial=0))) < 2**31 else np.int64
    out = np.repeat((starts - (np.cumsum(lengths) - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary per range of `values`, in the values' own bytes."""
    width = values.dtype.itemsize
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets * width, np.int64)), pa.py_buffer(data)])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table that a job writes and reads again, in the folder that all executors share."""
    _scratch.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def drop_scratch(spark: SparkSession, keep: int = 0) -> None:
    """Deletes the tables that this program's jobs wrote for themselves, but for the first `keep`; call it when no result that rests on them is still to be read."""
    while len(_scratch) > keep:
        _delete(spark, _scratch.pop())


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """Around a query and the reading of its result: drops the tables that were written meanwhile."""
    had = len(_scratch)
    try:
        yield
    finally:
        drop_scratch(spark, had)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind a frame of `materialise` once nothing rests on it any more."""
    if (path := getattr(df, "_scratch_path", None)) in _scratch:
        _scratch.remove(path)
        _delete(df.sparkSession, path)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it where a column of the frame has it; case does not count."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % 5


def bounded_sample(ids: DataFrame, key: str, most: int = MAX_TRAIN_ROWS) -> DataFrame:
    """At most `most` of the distinct rows: those whose key has the smallest hashes; small enough, whatever the input, to be broadcast.

    The rows are counted first, and only about twice as many as are wanted, by the range of their hashes, are made distinct and sorted: so
    no task meets more of them when the input grows. Null keys are left out.
    """
    h = F.shiftrightunsigned(F.xxhash64(key), 1)
    ids = ids.where(F.col(key).isNotNull())
    if (n := ids.count()) > 2 * most:
        ids = ids.where(h <= int(2**63 * (2 * most / n)))
    return ids.distinct().orderBy(h, key).limit(most)
