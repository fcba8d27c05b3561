"""Operator 6: exact Jaccard join of word shingles by adaptive multi-match prefixes.

All shingles have one order, rare ones first by a sketch of their frequency over the corpus and by what a first round of
prefixes shows to be common: passages that many texts share stand in no sketch of bounded size. Two sets that are similar
enough share at least l of the first |x| - ceil(t|x|) + l shingles of each. Each set takes the l for which the estimated
cost of its prefix's candidates is least; two sets must share the smaller of their two l before they are verified.

Groups of near-copies aren't joined pair by pair. Each set is first verified against the leader with which it shares most;
what those links join is one component, and afterwards only sets of unlike components that share enough are candidates.
Prefix shingles that stand in the same rows are one posting with their number, a pair is made at the first posting that its
rows share, and parities of the sets' hashes rule out most pairs that aren't similar before anything of them is sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED_LOWER, STEP, KeyFilter, coded, col, gram_keys, hashed, key_filter, map_texts, mixed, release, slices, staged, table, words
from .components import components

SKETCH = 1 << 20  # cells of the frequency sketch, 4 bytes each; a shingle that 1 in 1,000 texts or so have stands out of its cell
SHIFT = np.uint64(65 - SKETCH.bit_length())
LONGEST = 4  # the largest l
VERIFY = 8.0  # what a candidate costs, in postings read
#: Keys that are broadcast at most, 8 bytes each; beyond them the rows are joined.
BROADCAST_KEYS = 1 << 23
MOST_PAIRS = 1 << 21  # pairs that a task counts at once
ADDED = 64  # tasks whose sketches a group adds up
GATHERED = 1 << 20  # postings that a task gathers before it sends them to their buckets
COMMON = (8, 64, 512, 4096)  # rows of a prefix shingle from which it counts as common, by degrees
BUCKET = 1 << 21  # shingles of the corpus for which there is a bucket of postings
WORDS = 8  # words of 64 parities that stand for a set
EARLIER = 32  # postings of a row that its later ones name at most; beyond them a pair may be made more than once


class Sets:
    """The shingle sets of a slice's texts: hashes by row, ascending, each once."""

    def __init__(self, texts: pa.Array, k: int) -> None:
        array, per_text, _ = words(texts, SPACED_LOWER)
        codes, distinct = coded(array)
        keys = hashed(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        n = np.diff(per_text)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(keys))
        grams = np.zeros(len(keys), np.uint64)
        whole = gram_keys(keys, k)
        grams[: len(whole)] = whole
        valid = at + k <= per_text[1:][row]
        for r in np.flatnonzero((n > 0) & (n < k)).tolist():  # fewer words: their whole sequence
            start = per_text[r]
            grams[start] = mixed(gram_keys(keys[start : start + n[r]], int(n[r])) + STEP * np.array([n[r]], np.uint64))[0]
            valid[start] = True
        grams, row = grams[valid], row[valid]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])
        for start, stop in pairwise(ends.tolist()):
            grams[start:stop].sort()
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        self.hashes, self.row = grams[new], row[new]
        self.size = np.bincount(self.row, minlength=len(n))
        self.ends = np.concatenate([[0], np.cumsum(self.size)])

    def signatures(self) -> np.ndarray:
        """128 bits of each set."""
        out = np.zeros((2, len(self.size)), np.uint64)
        some = np.flatnonzero(self.size)
        for i in range(2):
            if len(some):
                out[i, some] = np.add.reduceat(mixed(self.hashes + np.array([i + 1], np.uint64) * STEP), self.ends[some])
        return out

    def parities(self) -> np.ndarray:
        """For each set, 64 * WORDS cells of its hashes: a bit that tells whether a cell has an odd number of them. Sets differ in as many shingles as bits, or more."""
        out = np.zeros((len(self.size), WORDS), np.uint64)
        word = self.row * WORDS + (self.hashes >> np.uint64(65 - WORDS.bit_length())).astype(np.int64)
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
        if len(word):
            bit = (self.hashes >> np.uint64(59 - WORDS.bit_length())) & np.uint64(63)
            out.ravel()[word[start]] = np.bitwise_xor.reduceat(np.uint64(1) << bit, start)
        return out


def row_keys(ids: np.ndarray, signatures: np.ndarray) -> np.ndarray:
    return mixed(mixed(ids.view(np.uint64) + STEP) ^ signatures[0])


def first_pass(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(id, n, sig, key, bits) of docs (id, text), key being row_keys of id and sig, bits the parities; and in how many texts the shingles of each of SKETCH cells stand, all texts counted.

    The sketch's size doesn't depend on docs: it is summed over all tasks piece by piece and comes to the driver.
    """
    pieces = 16

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH, np.int32)
        names = ["id", "n", "sig", "key", "bits", "piece", "part"]
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text"):
                s = Sets(part.column(1), k)
                cells += np.bincount((s.hashes >> SHIFT).astype(np.int64), minlength=SKETCH).astype(np.int32)
                both = s.signatures()
                sigs = pa.array([b.tobytes() for b in np.ascontiguousarray(both.T)], pa.binary())
                bits = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * WORDS), pa.array(s.parities().view(np.int64).ravel()))
                keys = row_keys(part.column(0).fill_null(0).to_numpy(zero_copy_only=False), both).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.size), sigs, pa.array(keys), bits, pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.int32())], names)
        if cells.any():
            some = pa.array([packed(c) for c in np.split(cells, pieces)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(pieces, pa.int64()), pa.nulls(pieces, pa.int64()), some, pa.nulls(pieces, pa.int64()), pa.nulls(pieces, pa.list_(pa.int64())), pa.array(range(pieces), pa.int32()), pa.array([task] * pieces, pa.int32())], names)
        pa.default_memory_pool().release_unused()

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // pieces, np.int64)
        for c in group.column("sig").to_pylist():
            total += np.frombuffer(pa.decompress(c, 4 * SKETCH // pieces, "zstd", asbytes=True), np.int32)
        total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        return pa.table({"piece": group.column("piece")[:1], "part": group.column("part")[:1], "sig": pa.array([packed(total)], pa.binary())})

    both = staged(docs.mapInArrow(each, "id long, n long, sig binary, key long, bits array<long>, piece int, part int"))
    found = both.where("piece is not null").select("piece", "part", "sig")
    last = found.agg(F.max("part")).head()[0] or 0
    while True:  # a group adds the pieces of ADDED tasks, and then those sums likewise
        found = found.withColumn("part", F.expr(f"part div {ADDED}").cast("int")).groupBy("piece", "part").applyInArrow(add, "piece int, part int, sig binary")
        last //= ADDED
        if not last:
            break
    out, rows = np.zeros(SKETCH, np.int32), found.toArrow()
    for piece, cells in zip(rows.column("piece").to_pylist(), rows.column("sig").to_pylist(), strict=True):
        out[piece * (SKETCH // pieces) : (piece + 1) * (SKETCH // pieces)] = np.frombuffer(pa.decompress(cells, 4 * SKETCH // pieces, "zstd", asbytes=True), np.int32)
    return both.where("piece is null").drop("piece", "part"), out


def prefixes(s: Sets, rows: np.ndarray, cells: np.ndarray, marks: list[tuple[int, KeyFilter]], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix shingles of the chosen rows as (hash, row), and each row's l. marks: filters of shingles that so many rows or more are known to have."""
    chosen = np.zeros(len(s.size), bool)
    chosen[rows] = True
    own = chosen[s.row]
    hashes, row = s.hashes[own], s.row[own]
    usual = max(1, int(cells.sum(dtype=np.int64)) // SKETCH)
    often = np.maximum(0, cells[(hashes >> SHIFT).astype(np.int64)].astype(np.int64) - 2 * usual)
    for least_often, mark in marks:
        often = np.where(mark.has(hashes), np.maximum(often, least_often), often)
    level = np.where(often > 0, 1 + np.log2(np.maximum(often, 1)).astype(np.int64), 0)
    by = np.argsort(row * 64 + level, kind="stable")
    hashes, row, often = hashes[by], row[by], often[by]
    size = np.where(chosen, s.size, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(len(hashes)) - ends[:-1][row]
    least = -(-num * size // den)  # shingles that any partner shares
    total = np.concatenate([[0], np.cumsum(often)])
    best, cost = np.ones(len(size), np.int64), np.full(len(size), np.inf)
    for length in range(1, LONGEST + 1):
        upto = np.minimum(size - least + length, size)
        c = (total[ends[:-1] + upto] - total[ends[:-1]]) * (1 + VERIFY / length**2)
        better = (c < cost) & (length <= np.maximum(least, 1))
        best, cost = np.where(better, length, best), np.where(better, c, cost)
    inside = place < (size - least + best)[row]
    return hashes[inside], row[inside], best


def packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True)


def unpacked(column: pa.ChunkedArray, sizes: list[int], kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.concatenate([np.frombuffer(pa.decompress(b, n * width, "zstd", asbytes=True), kind) for b, n in zip(column.to_pylist(), sizes, strict=True)])


OFTEN = "token long, n long"
LIVE = "token long, id long, n long, l int, often long, first long, second long"


def bucket_rows(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, id, n * 8 + l) of the postings of shingles that two rows or more share, by token, and where each token starts."""
    sizes = group.column("count").to_pylist()
    token = np.concatenate([np.frombuffer(b, np.uint64) for b in group.column("tokens").to_pylist()])
    ids, size = unpacked(group.column("ids"), sizes, np.int64), unpacked(group.column("sizes"), sizes, np.int64)
    by = np.argsort(token, kind="stable")
    token, ids, size = token[by], ids[by], size[by]
    same = token[1:] == token[:-1]
    live = np.append(same, False) | np.append(False, same)
    token, ids, size = token[live], ids[live], size[live]
    return token, ids, size, np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])


def common_tokens(group: pa.Table) -> pa.Table:
    """Shingles of a bucket that COMMON[0] rows or more share, as OFTEN."""
    token, _, _, start = bucket_rows(group)
    n = np.diff(np.append(start, len(token)))
    often = n >= COMMON[0]
    return pa.table({"token": token[start[often]].view(np.int64), "n": n[often]})


def live_tokens(group: pa.Table) -> pa.Table:
    """Postings of a bucket that two rows or more share, as LIVE; first and second are 128 bits of the rows that have the shingle."""
    token, ids, size, start = bucket_rows(group)
    n = np.diff(np.append(start, len(token)))
    rows = mixed(mixed(ids.view(np.uint64) + STEP) ^ size.view(np.uint64))
    sums = [np.add.reduceat(x, start) if len(start) else x for x in (rows, mixed(rows + STEP))]
    first, second, often = (np.repeat(x, n) for x in (*sums, n))
    return pa.table({"token": token.view(np.int64), "id": ids, "n": size >> 3, "l": (size & 7).astype(np.int32), "often": often, "first": first.view(np.int64), "second": second.view(np.int64)})


def bucketed_postings(docs: DataFrame, cells: np.ndarray, marks: list[tuple[int, KeyFilter]], k: int, num: int, den: int, dropped: Callable[[np.ndarray], np.ndarray], buckets: int) -> GroupedData:
    """The prefix shingles of all rows by buckets. They travel packed, a row for each slice and bucket."""
    shared = docs.sparkSession.sparkContext.broadcast((cells, marks))

    kind = pa.schema([("bucket", pa.int32()), ("count", pa.int32()), ("tokens", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        token, ids, size = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (token % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1])) if len(by) else by
        out: dict[str, list] = {n: [] for n in kind.names}
        for start, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=False):
            own = by[start:stop]
            for name, value in zip(out, (bucket[own[0]], stop - start, token[own].tobytes(), packed(ids[own]), packed(size[own])), strict=True):
                out[name].append(value)
        return pa.RecordBatch.from_pydict(out, schema=kind)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                s = Sets(part.column(1), k)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero((s.size > 0) & ~dropped(row_keys(ids, s.signatures())))
                token, row, best = prefixes(s, rows, *shared.value, num, den)
                held.append((token, ids[row], (s.size * 8 + best)[row]))
                waiting += len(token)
                if waiting > GATHERED:
                    yield dealt(held)
                    held, waiting = [], 0
        if held:
            yield dealt(held)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(emit, "bucket int, count int, tokens binary, ids binary, sizes binary").groupBy("bucket")


def bounded_keys(keys: DataFrame) -> np.ndarray | None:
    """The sorted keys, if there are no more than may be broadcast."""
    if keys.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        return None
    return np.sort(keys.toArrow().column(0).to_numpy())


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id, their first column, is in ids: without a shuffle where the ids may be broadcast."""
    keys = bounded_keys(ids)
    if keys is None:
        return rows.join(ids.hint("shuffle_hash"), "id", "left_semi")
    shared = rows.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(np.isin(batch.column(0).to_numpy(), shared.value)))
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, rows.schema)


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Each pair's sets meet by two joins; sets_of makes those of the pairs' ids, and no others."""
    sets = staged(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("left")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("right")), "b").select("a", "b", "left", "right")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return both.mapInArrow(decide, "a long, b long")


def close(pairs: DataFrame, base: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that their parities don't rule out."""
    bits = only(base.select("id", "n", "bits"), pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    both = pairs.join(bits.toDF("a", "n", "left"), "a").join(bits.toDF("b", "bn", "right"), "b")
    unlike = F.aggregate(F.zip_with("left", "right", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return both.where((num + den) * unlike <= (den - num) * (F.col("n") + F.col("bn"))).select("a", "b").distinct()


def left_over(n, length, num: int, den: int):
    """Shingles behind a prefix, for numbers, arrays and columns alike."""
    return -(-num * n // den) - length


def shared_least(first, second, num: int, den: int, most: Callable):
    """Prefix shingles that two similar sets (n, l) share at least.

    All shared shingles up to the prefix's end that comes first are in both prefixes; the others stand behind that prefix.
    So a similar pair's overlap, num / (num + den) of both sizes or more, can't be larger than the shared prefix shingles
    and what is left behind the one prefix or the other.
    """
    overlap = -(-num * (first[0] + second[0]) // (num + den))
    return overlap - most(left_over(*first, num, den), left_over(*second, num, den))


def shared_least_sql(num: int, den: int) -> str:
    """shared_least of (n, l) and (bn, bl) as SQL."""
    left = lambda n, length: f"((({num} * {n} + {den - 1}) div {den}) - {length})"
    return f"(({num} * (n + bn) + {num + den - 1}) div {num + den}) - greatest({left('n', 'l')}, {left('bn', 'bl')})"


def cross_pairs(group: pa.Table, num: int, den: int) -> pa.Table:
    """Pairs of rows of unlike components, with the shingles they must share, from the postings of a bucket of shingles.

    A row's postings in all buckets have one order for all rows; after counts the shingles of those from this one on, earlier
    names those before. From the first that two rows share each must have as many as they must share, so that only postings
    that early in both rows make a pair, and those that know of no posting before that both have.
    """
    token, ids, comp, n, length, after = (group.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("token", "id", "component", "n", "l", "after"))
    by = np.lexsort([ids, token])
    token, ids, comp, n, length, after = token[by], ids[by], comp[by], n[by], length[by], after[by]
    bits = group.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)[by]
    names = group.column("earlier").combine_chunks()
    name, name_at = names.flatten().to_numpy(), names.offsets.to_numpy() - names.offsets[0].as_py()
    before = lambda i: name[name_at[by[i]] : name_at[by[i] + 1]].tolist()
    bound = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
    held: list[np.ndarray] = []
    waiting = 0
    for start, stop in pairwise(bound.tolist()):
        for at in range(start, stop - 1):
            rest = slice(at + 1, stop)
            fits = (comp[rest] != comp[at]) & (ids[rest] != ids[at]) & (den * np.minimum(n[rest], n[at]) >= num * np.maximum(n[rest], n[at]))
            other = np.flatnonzero(fits) + at + 1
            need = np.maximum(np.minimum(length[other], length[at]), shared_least((n[other], length[other]), (n[at], length[at]), num, den, np.maximum))
            can = np.minimum(after[other], after[at]) >= need
            other, need = other[can], need[can]
            can = (num + den) * np.bitwise_count(bits[other] ^ bits[at]).sum(axis=1, dtype=np.int64) <= (den - num) * (n[other] + n[at])
            other, need = other[can], need[can]
            if len(other):
                known = set(before(at))
                new = np.array([known.isdisjoint(before(i)) for i in other.tolist()], bool)
                if new.any():
                    held.append(np.stack([np.full(int(new.sum()), ids[at]), ids[other[new]], need[new]]))
                    waiting += held[-1].shape[1]
        if waiting > MOST_PAIRS:
            held = [least_needs(np.concatenate(held, axis=1))]
            waiting = held[0].shape[1] // 2
    a, b, need = least_needs(np.concatenate(held, axis=1)) if held else np.zeros((3, 0), np.int64)
    return pa.table({"a": a, "b": b, "need": need})


def least_needs(rows: np.ndarray) -> np.ndarray:
    """Each pair (the first two rows) once, with the least of the third row."""
    rows = rows[:, np.lexsort(rows[::-1])]
    return rows[:, np.append(True, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))]


def jaccard_components(docs: DataFrame, *, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of texts whose k-word shingle sets have a Jaccard similarity of num/den or more: (id, n_shingles, component_id).

    Words stand between ASCII white space, A-Z in lower case. A text of fewer than k words has its whole sequence as one
    shingle. Similar texts are linked, component_id is the smallest id that links reach. Equal sets are one class, which
    joins as its smallest id; no link between unlike sets is lost. Shingles are 64-bit hashes.

    Null texts and texts without words: 0 shingles, linked with nothing. Null ids: not linked, null component. Repeated
    rows: each has a result; rows that share an id share its links. Very long texts are read whole. No rows: none come
    out. Ids are integers. Further columns, whatever their names, are left out.
    """
    out = placed_rows(docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")), k, num, den)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def placed_rows(named: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, n, sig, component) for each row of named (id, text); see jaccard_components."""
    spark = named.sparkSession
    base, cells = first_pass(named, k)
    usable = base.where("n > 0 and id is not null")
    classes = staged(usable.groupBy("sig").agg(F.min("id").alias("leader"), F.count("*").alias("copies")).where("copies > 1").select("sig", "leader"))
    copies = usable.join(classes, "sig").where("id <> leader").select("id", "sig", "key")
    linkable = named.where("id is not null")
    keys = bounded_keys(copies.select("key")) if classes.limit(1).count() else np.zeros(0, np.int64)
    if keys is None:  # too many to broadcast: the copies leave by a join
        with_sig = map_texts(linkable, "text", ["id", "text"], [T.StructField("sig", T.BinaryType())], lambda: lambda t: [pa.array([b.tobytes() for b in np.ascontiguousarray(Sets(t, k).signatures().T)], pa.binary())])
        linkable = with_sig.join(copies.select("id", "sig").distinct().hint("shuffle_hash"), ["id", "sig"], "left_anti").select("id", "text")
        keys = np.zeros(0, np.int64)
    out_keys = spark.sparkContext.broadcast(keys)
    dropped = lambda x: np.isin(x.view(np.int64), out_keys.value)
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(cells.sum(dtype=np.int64)) // BUCKET))
    # the sketch's cells fill with the corpus, so prefixes first tell which of their own shingles are common, and are made anew
    found = staged(bucketed_postings(linkable, cells, [], k, num, den, dropped, buckets).applyInArrow(common_tokens, OFTEN))
    marks = [(n, key_filter(found.where(F.col("n") >= n), "token")) for n in COMMON]
    every = staged(bucketed_postings(linkable, cells, marks, k, num, den, dropped, buckets).applyInArrow(live_tokens, LIVE))
    # shingles that stand in the same rows are one from here on, with their number as its weight
    alike = staged(every.groupBy("first", "second").agg(F.min("token").alias("token"), (F.count("*") / F.first("often")).cast("long").alias("weight")).select("token", "weight"))
    live = staged(every.join(alike, "token").select("token", "id", "n", "l", "weight"))
    release(found, every, alike)

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, hashes) of the rows that have these ids, from their texts: no others' sets are made or written."""

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    s = Sets(part.column(1), k)
                    own = ~dropped(row_keys(part.column(0).to_numpy(zero_copy_only=False), s.signatures())) & (s.size > 0)
                    sets = [s.hashes[s.ends[r] : s.ends[r + 1]].tobytes() for r in np.flatnonzero(own)]
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(own)), pa.array(sets, pa.binary())], ["id", "hashes"])
            pa.default_memory_pool().release_unused()

        return only(linkable, ids).mapInArrow(gather, "id long, hashes binary")

    # each set with the leader with which it shares most prefix shingles; twice, as the first leader may be none of its kind
    links, tried, spent = None, None, []
    for _ in range(2):
        named_live = live if tried is None else live.join(tried.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
        first = staged(named_live.groupBy("token").agg(F.min("id").alias("b"), F.min_by("n", "id").alias("bn"), F.min_by("l", "id").alias("bl")))
        met = named_live.join(first, "token").where("id <> b").groupBy(F.col("id").alias("a"), "b")
        shared = met.agg(F.sum("weight").alias("shared"), F.first("n").alias("n"), F.first("l").alias("l"), F.first("bn").alias("bn"), F.first("bl").alias("bl"))
        need = F.expr(shared_least_sql(num, den))
        shared = shared.where((F.col("shared") >= need) & (den * F.least("n", "bn") >= num * F.greatest("n", "bn")))
        best = shared.groupBy("a").agg(F.min(F.struct(-F.col("shared"), "b")).alias("best"))
        pairs = staged(best.select("a", "best.b"))
        near = staged(close(pairs, usable, num, den))
        good = staged(verified(near, sets_of, num, den))
        links = good if links is None else links.unionByName(good)
        failed = staged(pairs.join(good, ["a", "b"], "left_anti"))
        tried = failed if tried is None else tried.unionByName(failed)
        spent += [first, pairs, near, good, failed]
    named_comp = components(links)

    # what is left: sets of unlike components that may share as many prefix shingles as the smaller l asks. Parities have left
    # few pairs, and to count what they share would move more than their sets do.
    placed = live.join(named_comp, F.col("id") == F.col("node"), "left").select("token", "id", "n", "l", "weight", F.coalesce("component", "id").alias("component"))
    placed = staged(placed)
    release(live)
    mixed_tokens = staged(placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("often")).where("x <> y").select("token", "often"))
    # rows that share an id are told apart by size and parities, so that none speaks for another
    own = Window.partitionBy("id", "n", "l", "bits").orderBy("often", "token")  # rare shingles stand first
    full = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = placed.join(mixed_tokens, "token").join(only(usable.select("id", "n", "bits"), placed.select("id").distinct()).distinct(), ["id", "n"])
    ranked = known.withColumn("rank", F.row_number().over(own)).withColumn("after", F.sum("weight").over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    leading = F.collect_list(F.when(F.col("rank") <= EARLIER, F.col("token"))).over(full)
    rest = staged(ranked.withColumn("earlier", leading).withColumn("earlier", F.slice("earlier", F.lit(1), F.least(F.col("rank") - 1, F.lit(EARLIER)))).drop("rank"))
    release(placed, mixed_tokens)
    bucketed = rest.withColumn("bucket", F.pmod("token", F.lit(buckets)))
    met = bucketed.groupBy("bucket").applyInArrow(lambda t: cross_pairs(t, num, den), "a long, b long, need long").select("a", "b").distinct()
    again = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    late = staged(verified(staged(met.join(again, ["a", "b"], "left_anti")), sets_of, num, den))
    final = components(links.unionByName(late)) if late.limit(1).count() else named_comp
    final = staged(final)
    release(rest, *spent)
    # copies take their leader's component: a class of any size is never a set of links
    led = base.join(classes, "sig", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("leader", "id")).otherwise(F.col("id")))
    out = led.join(final, F.col("root") == F.col("node"), "left")
    return out.select("id", "n", "sig", F.when(F.col("id").isNotNull(), F.coalesce("component", "root")).alias("component"))


def one_of_each(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, without the rows that are in a component with a smaller id.

    Of rows alike in id and shingle set one stays. Rows with null ids stay, and so do rows without words. No rows: none
    come out. Columns may have any names, dots included.
    """
    placed = staged(placed_rows(docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")), k, num, den))
    gone = placed.where("component < id").select(F.col("id").alias("__gone")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    by, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    kept = plain.join(gone.hint("shuffle_hash"), F.col(by).cast("long") == F.col("__gone"), "left_anti")
    twice = staged(placed.where("n > 0 and id is not null and component = id").groupBy("id", "sig").count().where("count > 1").select(F.col("id").alias("__twice")).distinct())
    if twice.limit(1).count():
        alike = kept.join(twice, F.col(by).cast("long") == F.col("__twice"), "left_semi")
        signed = map_texts(alike, text, names, [T.StructField("sig", T.BinaryType())], lambda: lambda t: [pa.array([b.tobytes() for b in np.ascontiguousarray(Sets(t, k).signatures().T)], pa.binary())])
        kept = kept.join(twice, F.col(by).cast("long") == F.col("__twice"), "left_anti").unionByName(signed.dropDuplicates([by, "sig"]).select(*names))
    return kept.select(*names).toDF(*docs.columns)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at a similarity of 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents"))
