"""Helpers that the operators of this subpackage share: shared scratch tables, Arrow slices, words and keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that one step of a task holds at a time; a longer single text is a slice of its own.
SLICE_BYTES = 2 << 20
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path in the folder that the cluster shares, which spark.checkpoint.dir or setCheckpointDir names.

    Only a local master, as in tests, gets a folder of its own where none is set; a cluster gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and no lost executor takes it along."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_in = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what staged() wrote for frames that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_in)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about limit bytes together."""
    column = batch.column(batch.schema.get_field_index(text_col))
    ends = np.cumsum(np.diff(offsets_of(column)))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def offsets_of(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    if not len(array):
        return np.zeros(1, np.int64)
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and each text's offsets; a null text has none."""
    array = array.fill_null("") if array.null_count else array
    off = offsets_of(array)
    if off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(array.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def byte_table(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to words, and what stands for it."""
    keep, to = np.ones(256, bool), np.arange(256, dtype=np.uint8)
    keep[list(separators)] = False
    if lower:
        to[65:91] += 32
    return keep, to


#: Words between ASCII white space, as they are and with A-Z in lower case.
SPACED = byte_table(b" \t\n\x0b\x0c\r", lower=False)
SPACED_LOWER = byte_table(b" \t\n\x0b\x0c\r", lower=True)
#: Words of digits, letters and all that isn't ASCII, with A-Z in lower case.
ALNUM_LOWER = byte_table(bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)), lower=True)


def words(array: pa.Array, kind: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of all texts, the offsets of each text's words, and each word's first byte in the slice."""
    keep, to = kind
    data, off = text_bytes(array)
    inside = keep[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < len(data)]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    kept = np.flatnonzero(inside)
    at = np.append(np.searchsorted(kept, starts), len(kept))
    values = pa.py_buffer(np.ascontiguousarray(to[data[kept]]))
    if at[-1] < 2**31:
        out = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int32)), values)
    else:
        out = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), values)
    return out, np.searchsorted(starts, off), starts


def coded(array: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Each word's place among the distinct words, and those."""
    got = array.dictionary_encode()
    return got.indices.to_numpy(zero_copy_only=False), got.dictionary.cast(pa.binary() if pa.types.is_string(array.type) else pa.large_binary()).to_pylist()


def hashed(distinct: list[bytes]) -> np.ndarray:
    """64-bit keys of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    return x ^ (x >> np.uint64(31))


def gram_keys(keys: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key for each run of n word keys, wherever it starts with n words to go."""
    m = max(0, len(keys) - n + 1)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * (STEP | np.uint64(1)) + keys[i : i + m]
        if i % 4 == 3:
            out = mixed(out)
    return mixed(out)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """For each word the row of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def map_texts(df: DataFrame, text_col: str, carry: list[str], fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]], limit: int = SLICE_BYTES) -> DataFrame:
    """df's columns carry, followed by what the function that make() returns in each task gives for slices of text_col. No shuffle."""
    carried = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").alias("__sliced"))
    schema = T.StructType([*carried.schema.fields[:-1], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        names = [f.name for f in schema.fields]
        for batch in batches:
            for part in slices(batch, "__sliced", limit):
                made = each(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names)
        pa.default_memory_pool().release_unused()

    return carried.mapInArrow(run, schema)


def col(name: str) -> F.Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def filter_texts(docs: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows of docs, with all their columns, that the function which make() returns in each task keeps by their texts. No shuffle."""
    plain, at = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                yield part.filter(pa.array(keep(part.column(at)), pa.bool_()))
        pa.default_memory_pool().release_unused()

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out(id_col: str = "doc_id") -> F.Column:
    """The fold on which nothing is learnt: a third of the ids, by checksum. False where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Bits of a key filter at most: 32 MB that every task can hold, however many keys there are.
FILTER_BITS = 28


class KeyFilter:
    """Whether 64-bit keys may be in a set: a bit for each range of keys. It never misses one; how many others pass depends on its size."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def key_filter(keys: DataFrame, name: str = "key", share: int = 5) -> KeyFilter:
    """A filter of about 2^share bits a key for a column of well-mixed 64-bit keys, with FILTER_BITS at most.

    It is gathered as words of 64 bits, summed up on the executors: no more than the filter's size comes to the driver.
    """
    n = keys.count()
    bits = min(FILTER_BITS, max(16, (n << share).bit_length()))
    at = F.shiftrightunsigned(F.col(name), 64 - bits)
    found = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({name}, {64 - bits}) & 63 as int))")).alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return KeyFilter(bits, words)
