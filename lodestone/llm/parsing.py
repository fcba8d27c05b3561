"""Operator 12: removal of repeated byte strings by prefix-free parsing.

Parsing. A rolling hash over the bytes names the triggers: grams that are the least of some window, so that every window
has one (a fixed modulus would leave windows without any). A phrase is all the text of the windows in a row that have the
same trigger; neighbouring phrases overlap by a window less one byte. Every window of a text is so in exactly one phrase,
and equal windows have equal triggers wherever they stand. A text is the sequence of its phrases: the parse.

Dictionary. Phrases that are alike are one entry with many places, so repetitive text costs little: of an entry whose
trigger no other entry has, and has it once, all places but the first go whole, and its bytes are never moved. Entries that share their
trigger with others are gathered by trigger, each once in a slice of the corpus. Their suffix array, made by doubling,
orders the windows that begin inside them; windows of equal rank are the same bytes. Entries stand in the order of their
first places in the parse, so that dictionary and parse together give the corpus order, in which all but the first go.

A trigger with more entries than fit a task is parsed on, down to phrases of one window; equal ones are then one entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIX1, MIX2, STEP, col, key_filter, mixed, release, slices, staged, table, text_bytes
from .substrings import sliding, spread

WINDOW = 100
#: A trigger has 2 to this power bytes.
TRIGGER = 5
#: Entries with which a trigger is parsed on, and those of a bucket of triggers.
ENTRIES, BUCKET = 1 << 12, 1 << 14
LOW_ID = np.iinfo(np.int64).min
#: What a row stands for: a place that goes, a place of an entry with a trigger of its own, an entry that shares its trigger.
GOES, ALONE, SHARED = 0, 1, 2
PLACES = T.StructType([T.StructField("kind", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("trigger", "high", "low", "id", "hash", "start", "n")], T.StructField("bytes", T.BinaryType())])
SPANS = "id long, hash long, start long, n long"


def rolled(data: np.ndarray, power: int) -> np.ndarray:
    """A 64-bit hash of the 2^power bytes from each place on."""
    h = (data.astype(np.uint64) + np.uint64(1)) * MIX1
    for k in range(power):
        n = 1 << k
        h = h[: max(0, len(h) - n)] * (STEP ^ np.uint64(k << 8)) + h[n:]
        h ^= h >> np.uint64(29)
    return h * MIX2


class Parse:
    """The phrases of a slice's texts: row, start in the text, first byte in the slice, windows n, trigger, and 128 bits of the bytes."""

    def __init__(self, texts: pa.Array, window: int, power: int) -> None:
        self.data, self.off = text_bytes(texts)
        self.data = np.ascontiguousarray(self.data)
        self.hashes, self.wide = hashes, wide = rolled(self.data, power), window - (1 << power) + 1
        least = sliding(hashes, wide, np.minimum) if len(hashes) >= wide else hashes[:0]
        row = np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))[: len(least)]
        inside = np.arange(len(least)) + window <= self.off[1:][row]
        new, last = inside.copy(), inside.copy()
        new[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        last[:-1] &= ~inside[1:] | new[1:]
        self.at = np.flatnonzero(new)
        self.n = np.flatnonzero(last) - self.at + 1
        self.least = least[self.at]
        self.row, self.trigger, self.window = row[self.at], mixed(self.least), window

    def only(self, some: np.ndarray) -> None:
        self.at, self.n, self.row, self.trigger = (x[some] for x in (self.at, self.n, self.row, self.trigger))

    def start(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        return at - self.off[:-1][row]

    def inner(self) -> np.ndarray:
        """Which phrases hold their trigger twice: only in those can one window stand at several places."""
        size = self.n + self.wide - 1
        if not len(size):
            return np.zeros(0, bool)
        hits = self.hashes[spread(self.at, size)] == np.repeat(self.least, size)
        return np.add.reduceat(hits.astype(np.int32), np.cumsum(size) - size) > 1

    def digests(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """128 bits of the bytes of n windows each, as two columns."""
        view = memoryview(self.data)
        out = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(at.tolist(), (at + n + (self.window - 1)).tolist())])
        return np.frombuffer(out, np.int64).reshape(-1, 2)

    def bytes_of(self, at: np.ndarray, n: np.ndarray) -> pa.Array:
        size = n + self.window - 1 if len(n) else n
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(self.data[spread(at, size)])])


ENTRY = ["trigger", "high", "times", "inner"]


def entries(texts: pa.Array, window: int, power: int) -> pa.RecordBatch:
    """The slice's distinct phrases: their trigger, 64 bits of the bytes, and whether they hold the trigger twice."""
    p = Parse(texts, window, power)
    trigger, high = p.trigger.view(np.int64), p.digests(p.at, p.n)[:, 0]
    by = np.lexsort([high, trigger])
    head = np.flatnonzero(np.append(True, (trigger[by][1:] != trigger[by][:-1]) | (high[by][1:] != high[by][:-1]))) if len(by) else by
    first, times = by[head], np.diff(np.append(head, len(by)))
    return pa.RecordBatch.from_arrays([pa.array(trigger[first]), pa.array(high[first]), pa.array(times), pa.array(p.inner()[first])], ENTRY)


def again(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with the same keys, the first by place; and the others, but for those at the very place of the first."""
    by = np.lexsort([*place[::-1], *keys])
    same = np.append(False, np.all([k[by][1:] == k[by][:-1] for k in keys], axis=0)) if len(by) else np.zeros(0, bool)
    heads = np.flatnonzero(~same)
    head = np.repeat(by[heads], np.diff(np.append(heads, len(by))))
    other = same & np.any([p[by] != p[head] for p in place], axis=0) if len(by) else same
    return by[heads], by[other]


def parsed(batch: pa.RecordBatch, window: int, power: int, kinds: dict) -> pa.RecordBatch:
    """The places of columns id, hash, text whose triggers are in more places than one, by kind (see PLACES)."""
    p = Parse(batch.column(2), window, power)
    p.only(np.any([k.has(p.trigger) for k in kinds.values()], axis=0))
    ids, hashes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    wide, shared = kinds["wide"].has(p.trigger), kinds["shared"].has(p.trigger)
    # phrases of one window each where the trigger is wide
    at = np.concatenate([p.at[~wide], spread(p.at[wide], p.n[wide])])
    n = np.concatenate([p.n[~wide], np.ones(int(p.n[wide].sum()), np.int64)])
    row, trigger = (np.concatenate([x[~wide], np.repeat(x[wide], p.n[wide])]) for x in (p.row, p.trigger))
    kind = np.concatenate([np.where(shared[~wide], SHARED, ALONE), np.full(len(at) - int((~wide).sum()), ALONE)])
    digest, start = p.digests(at, n), p.start(at, row)
    place = [ids[row], hashes[row], start]
    first, others = again([digest[:, 0], digest[:, 1]], place)
    keep = np.concatenate([first, others])
    kind = np.concatenate([kind[first], np.full(len(others), GOES)])
    some = first[kind[: len(first)] == SHARED]
    texts = p.bytes_of(at[some], n[some])
    where = np.full(len(keep), -1)
    where[np.flatnonzero(kind == SHARED)] = np.arange(len(some))
    columns = [pa.array(kind, pa.int32()), *(pa.array(x[keep]) for x in (trigger.view(np.int64), digest[:, 0], digest[:, 1], *place, n))]
    return pa.RecordBatch.from_arrays([*columns, texts.take(pa.array(where, mask=where < 0))], PLACES.names)


def ranks(data: np.ndarray, window: int, places: np.ndarray) -> np.ndarray:
    """The places in the suffix array of data as far as window bytes order it: equal numbers where the windows are alike."""
    rank, done, half = data.astype(np.uint64), 1, np.uint64(32)
    while done < 4 and done * 2 <= window:  # packed bytes are their own rank
        rank, done = (rank[: len(rank) - done] << np.uint64(8 * done)) | rank[done:], done * 2
    while done * 2 <= window:
        _, rank = np.unique((rank[: len(rank) - done] << half) | rank[done:], return_inverse=True)
        rank, done = rank.astype(np.uint64), done * 2
    return (rank[places] << half) | rank[places + window - done]


def repeated(group: pa.Table, window: int) -> pa.Table:
    """The runs of windows (id, hash, start, n) of a bucket's entries that also stand earlier, in the corpus order."""
    high, low, ids, hashes, start, n = (group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("high", "low", "id", "hash", "start", "n"))
    first, others = again([high, low], [ids, hashes, start])
    first = first[np.lexsort([start[first], hashes[first], ids[first]])]  # the dictionary in the order of the parse
    texts = group.column("bytes").combine_chunks().take(pa.array(first))
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    at = np.concatenate([[0], np.cumsum(n[first] + window - 1)])[:-1]
    place, entry = spread(at, n[first]), np.repeat(np.arange(len(first)), n[first])
    _, kept = np.unique(ranks(data, window, place), return_index=True)
    gone = np.ones(len(place), bool)
    gone[kept] = False
    new = gone.copy()
    new[1:] &= ~gone[:-1] | (entry[1:] != entry[:-1])
    head = np.flatnonzero(new)
    size = np.add.reduceat(gone.astype(np.int64), head) if len(head) else head
    who = first[entry[head]]
    begin = start[who] + place[head] - at[entry[head]]
    columns = [np.concatenate(x) for x in ((ids[who], ids[others]), (hashes[who], hashes[others]), (begin, start[others]), (size, n[others]))]
    return pa.table(dict(zip(("id", "hash", "start", "n"), columns)))


def in_slices(make: Callable[[pa.RecordBatch], pa.RecordBatch], at: str = "text") -> Callable:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield make(part)
        pa.default_memory_pool().release_unused()

    return each


def repeated_windows(texts: DataFrame, window: int, power: int, most: int, bucket: int) -> DataFrame:
    """(id, hash, start, n): runs of windows of texts (id, hash, text) that stand earlier in the corpus too."""
    spark = texts.sparkSession
    found = texts.select("text").mapInArrow(in_slices(lambda part: entries(part.column(0), window, power)), "trigger long, high long, times long, inner boolean")
    by_trigger = found.groupBy("trigger").agg(F.count("*").alias("n"), F.sum("times").alias("times"), ((F.min("high") != F.max("high")) | F.max("inner")).alias("shared"))
    kind = F.when(~F.col("shared"), "alone").when(F.col("n") > most, "wide").otherwise("shared")
    triggers = staged(by_trigger.where("times > 1 OR shared").select("trigger", kind.alias("kind")))
    kinds = {k: key_filter(triggers.where(F.col("kind") == k), "trigger") for k in ("alone", "shared", "wide")}
    sent = spark.sparkContext.broadcast(kinds)
    places = staged(texts.select("id", "hash", "text").mapInArrow(in_slices(lambda part: parsed(part, window, power, sent.value)), PLACES))
    sent.unpersist()
    release(triggers)
    alone = places.where(F.col("kind") == ALONE).select("high", "low", F.struct("id", "hash", "start").alias("place"), "n")
    firsts = staged(alone.groupBy("high", "low").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first != last").select("high", "low", "first"))
    late = alone.join(firsts, ["high", "low"]).where(F.col("place") != F.col("first")).select("place.id", "place.hash", "place.start", "n")
    shared = places.where(F.col("kind") == SHARED)
    buckets = max(1, -(-shared.count() // bucket))
    inside = shared.withColumn("bucket", F.pmod(F.xxhash64("trigger"), F.lit(buckets))).groupBy("bucket").applyInArrow(lambda t: repeated(t, window), SPANS)
    return places.where(F.col("kind") == GOES).select("id", "hash", "start", "n").unionByName(late).unionByName(inside)


KEPT = "n_bytes long, removed array<struct<start:long,bytes:long>>, kept binary"


def without_repeats(docs: DataFrame, *, window: int = WINDOW, trigger: int = TRIGGER, entries: int = ENTRIES, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, removed, kept), one row per row of docs: bytes under a string of window bytes that stands earlier are out.

    Texts are UTF-8 bytes; strings never cross texts. A string goes if it also begins earlier: by smaller id, then smaller
    hash of the text, then start; overlaps count. removed has the maximal runs of removed bytes, kept the other bytes,
    which needn't be whole characters. Entries of a shared trigger are compared byte by byte; those that are alike whole
    are so by 128 bits of BLAKE2.

    Null text: no bytes, as the empty text. Texts shorter than a window are kept. Rows alike in id and text are one document
    and are treated alike; rows that share only an id are documents of their own. Null ids come first. Very long texts are
    read whole, in linear time. No rows: none come out. Ids are integers. Further columns, whatever their names, are left out.
    """
    if window < 1 << trigger:
        raise ValueError("a trigger fits into a window")
    named = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(LOW_ID)).alias("id"), F.xxhash64(col(text_col)).alias("hash"), col(text_col).alias("text"), col(id_col).isNull().alias("no_id"))
    spans = repeated_windows(named, window, trigger, entries, bucket)
    per_text = spans.groupBy(F.col("id").alias("sid"), F.col("hash").alias("shash")).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    whole = named.join(per_text.hint("shuffle_hash"), (F.col("id") == F.col("sid")) & (F.col("hash") == F.col("shash")), "left")
    schema = T.StructType([T.StructField(id_col, T.LongType()), *T._parse_datatype_string(KEPT).fields])
    ready = whole.select(F.when(~F.col("no_id"), F.col("id")).alias("id"), "text", "spans")
    return ready.mapInArrow(in_slices(lambda part: kept_of(part, window, schema.names)), schema)


def kept_of(batch: pa.RecordBatch, window: int, names: list[str]) -> pa.RecordBatch:
    """The bytes of each text (id, text, spans) that no removed window covers."""
    data, off = text_bytes(batch.column(1))
    spans = batch.column(2)
    many = pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False)
    flat = spans.drop_null().flatten()
    begin = off[:-1][np.repeat(np.arange(len(many)), many)] + flat.field("start").to_numpy(zero_copy_only=False)
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + flat.field("n").to_numpy(zero_copy_only=False) + (window - 1), -1)
    out = np.cumsum(change)[:-1] > 0
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    new = out.copy()
    new[1:] &= ~out[:-1] | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    size = np.add.reduceat(out.astype(np.int64), head) if len(head) else head
    runs = pa.StructArray.from_arrays([pa.array(head - off[:-1][row[head]]), pa.array(size)], ["start", "bytes"])
    ends = lambda of: np.concatenate([[0], np.cumsum(np.bincount(of, minlength=batch.num_rows))])
    kept = np.flatnonzero(~out)
    left = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends(row[kept]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[kept]))])
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(ends(row[head]).astype(np.int32)), runs), left.cast(pa.binary())], names)


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 100 bytes that stand earlier in the corpus."""
    kept = without_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["bytes"])
    return kept.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
