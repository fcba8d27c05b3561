"""Operator 4: benchmark decontamination by suffix arrays over training texts, in which every test suffix is searched."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_LOWER, filter_texts, map_texts, table, words

#: Test texts that one pass searches for: a block of this many bytes is broadcast, and further blocks take passes of their own.
BLOCK_BYTES = 8 << 20

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("item_start", T.LongType()), T.StructField("length", T.LongType())])
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH, False))]


@dataclass
class Block:
    """A block of test items: their words as numbers from 1, one item after another, and the items of each distinct sequence."""

    vocabulary: pa.Array
    letters: np.ndarray
    offsets: np.ndarray
    items: list[list[str]]
    window: np.ndarray  # words that a match has at least: by sequence

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """The test suffixes that are long enough for a window: where they start, and their sequence."""
        n = np.diff(self.offsets) - self.window + 1
        own = np.repeat(np.arange(len(n)), n)
        return self.offsets[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n), own


def block_of(rows: list, window: int) -> Block | None:
    """rows: (id as text, text). Items of the same words share a sequence; items without words are left out."""
    array, per_text, _ = words(pa.array([r[1] for r in rows], pa.string()), ALNUM_LOWER)
    coded = array.dictionary_encode()
    letters = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    same: dict[bytes, list[int]] = {}
    for i in range(len(rows)):
        if per_text[i] < per_text[i + 1]:
            same.setdefault(letters[per_text[i] : per_text[i + 1]].tobytes(), []).append(i)
    if not same:
        return None
    each = [np.frombuffer(k, np.int64) for k in same]
    sizes = np.array([len(x) for x in each])
    return Block(coded.dictionary, np.concatenate(each), np.concatenate([[0], np.cumsum(sizes)]), [[rows[i][0] for i in v] for v in same.values()], np.minimum(sizes, window))


def packed(letters: np.ndarray, at: np.ndarray, depth: int, bits: int, upto: np.ndarray | None = None, fill: int = 0) -> np.ndarray:
    """The first depth letters from each place as columns of 64-bit numbers, in which order is that of the letters; from upto on, fill."""
    each = 63 // bits
    out = np.zeros((-(-depth // each), len(at)), np.int64)
    for i in range(out.shape[0] * each):
        some = letters[np.minimum(at + i, len(letters) - 1)] * (at + i < len(letters)) if i < depth else np.zeros(len(at), np.int64)
        if upto is not None:
            some = np.where(i < upto, some, fill)
        out[i // each] |= some << (bits * (each - 1 - i % each))
    return out


def bound(columns: np.ndarray, order: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all wanted at once: the first place in the suffix array that isn't before it, or is after it."""
    low, high = np.zeros(wanted.shape[1], np.int64), np.full(wanted.shape[1], len(order), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        at = order[np.minimum(mid, len(order) - 1)]
        less, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
        for have, want in zip(columns[:, at], wanted, strict=True):
            less |= equal & (have < want)
            equal &= have == want
        right = open_ & (less | equal if after else less)
        low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
    return low


def searcher(block: Block) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """A function of texts: words of each, and the longest matches as (row, sequence, start, item start, length)."""
    bits = max(1, int(len(block.vocabulary)).bit_length())
    depth, least = int(block.window.max()), int(block.window.min())
    at, own = block.suffixes()
    upto = block.window[own]
    # suffixes with the same window are searched once
    keys = packed(block.letters, at, depth, bits, upto)
    low_keys, which = np.unique(np.vstack([keys, upto[None]]), axis=1, return_inverse=True)
    which = which.reshape(-1)
    first = np.zeros(low_keys.shape[1], np.int64)
    first[which] = np.arange(len(which))
    high_keys = packed(block.letters, at[first], depth, bits, upto[first], (1 << bits) - 1)
    by_window = np.argsort(which, kind="stable")
    window_ends = np.searchsorted(which[by_window], np.arange(low_keys.shape[1] + 1))

    def search(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        array, per_text, _ = words(texts, ALNUM_LOWER)
        n_words = np.diff(per_text)
        none = [np.zeros(0, np.int64)] * 5
        if not len(array):
            return n_words, none
        coded = array.dictionary_encode()
        vocabulary = block.vocabulary.cast(coded.dictionary.type)
        letters = pc.fill_null(pc.index_in(coded.dictionary, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)] + 1
        # a letter 0 follows each text; only suffixes that begin with test words alone can match
        row = np.repeat(np.arange(len(n_words)), n_words)
        spread = np.zeros(len(letters) + len(n_words), np.int64)
        place = np.arange(len(letters)) + row
        spread[place] = letters
        stop = np.flatnonzero(spread == 0)
        run = stop[np.searchsorted(stop, place)] - place
        starts = place[run >= least]
        if not len(starts):
            return n_words, none
        columns = packed(spread, starts, depth, bits)
        order = np.lexsort(columns[::-1])  # the suffix array, sorted as far as any window reaches
        low = bound(columns, order, low_keys[:-1], after=False)
        high = bound(columns, order, high_keys, after=True)
        hits = high - low
        window = np.repeat(np.arange(len(hits)), hits)
        found = starts[order[np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(len(window))]] if len(window) else np.zeros(0, np.int64)
        # each occurrence of a window is one of every test suffix that begins with it
        many = np.diff(window_ends)[window]
        suffix = by_window[np.repeat(window_ends[window] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        found = np.repeat(found, many)
        # neighbouring windows of the same diagonal are one longest match
        sequence, item_start = own[suffix], at[suffix] - block.offsets[own[suffix]]
        by = np.lexsort([found, found - item_start, sequence])
        found, sequence, item_start = found[by], sequence[by], item_start[by]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1] + 1) | (sequence[1:] != sequence[:-1]) | (item_start[1:] != item_start[:-1] + 1)
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(found))) + block.window[sequence[head]] - 1
        doc = np.searchsorted(per_text[1:] + np.arange(len(n_words)), found[head], "right")
        start = found[head] - per_text[doc] - doc
        by = np.lexsort([item_start[head], start, doc])
        return n_words, [x[by] for x in (doc, sequence[head], start, item_start[head], length)]

    return search


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The test items in blocks of about block_bytes, each of which alone comes to the driver."""
    named = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    size = named.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        yield named.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()


def find_matches(docs: DataFrame, items: DataFrame, *, window: int = 10, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Longest verbatim matches of test items in training texts: (id, n_words, matches), one row per row of docs.

    Words are runs of digits, letters and non-ASCII characters, with A-Z in lower case. A match has at least window words,
    or the whole of a shorter item; matches tell item_id, start and item_start in words, and length, and are as long as
    the texts agree. Each slice of training texts gets a suffix array of all suffixes that begin with enough test words,
    in which every test suffix is found by binary search. Test items pass through the driver in blocks of block_bytes, so
    that what is broadcast is bounded; each block is one more pass over docs, without a shuffle.

    Null or empty text: 0 words, no matches; null or wordless items are never found. A null item id: null in matches.
    Repeated rows and ids: each row has its own result; items of the same words are all listed. Empty tables: no rows, or
    no matches. Further columns of docs are left out.
    """
    spark = docs.sparkSession
    out = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.lit(None).cast("long").alias("n_words"), F.array().cast(T.ArrayType(MATCH, False)).alias("matches"))
    for rows in blocks(items, item_id_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(block_of(rows, window))
        out = one_pass(out, shared)
    return out.select(F.col("__id").alias(id_col), "n_words", "matches")


def one_pass(docs: DataFrame, shared) -> DataFrame:
    def make() -> Callable[[pa.Array], list[pa.Array]]:
        block = shared.value
        search = searcher(block) if block else None

        def each(texts: pa.Array) -> list[pa.Array]:
            if search is None:
                return [pa.array(np.diff(words(texts, ALNUM_LOWER)[1])), pa.array([[]] * len(texts), FOUND_TYPE)]
            n_words, (doc, sequence, start, item_start, length) = search(texts)
            many = np.array([len(x) for x in block.items])[sequence]
            ids = pa.array([i for s in sequence.tolist() for i in block.items[s]], pa.string())
            structs = pa.StructArray.from_arrays([ids, *(pa.array(np.repeat(x, many), pa.int64()) for x in (start, item_start, length))], names=MATCH.names)
            per_row = np.bincount(doc, many, len(texts)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
            return [pa.array(n_words), pa.ListArray.from_arrays(pa.array(ends), structs).cast(FOUND_TYPE)]

        return each

    fields = [T.StructField("__n", T.LongType()), T.StructField("__found", FOUND[1].dataType)]
    found = map_texts(docs, "__text", ["__id", "__text", "matches"], fields, make)
    return found.select("__id", "__text", F.col("__n").alias("n_words"), F.concat("matches", "__found").alias("matches"))


FOUND_TYPE = pa.list_(pa.field("element", pa.struct([pa.field("item_id", pa.string()), pa.field("start", pa.int64()), pa.field("item_start", pa.int64()), pa.field("length", pa.int64())]), nullable=False))


def hit_words() -> F.Column:
    """Words inside any match, from matches: those of each that are behind all earlier ones' ends."""
    ordered = F.array_sort(F.transform("matches", lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["length"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))
    step = lambda s, m: F.struct((s["hit"] + F.greatest(F.lit(0).cast("long"), m["b"] - F.greatest(s["end"], m["a"]))).alias("hit"), F.greatest(s["end"], m["b"]).alias("end"))
    return F.aggregate(ordered, zero, step, lambda s: s["hit"])


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no match of a test item is found (see find_matches).

    Null and empty texts stay; repeated rows are judged alike. Empty tables: no rows, or all of docs. Columns may have any
    names, dots included.
    """
    spark, out = docs.sparkSession, docs
    for rows in blocks(items, item_id_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(block_of(rows, window))

        def make(shared=shared) -> Callable[[pa.Array], np.ndarray]:
            search = searcher(shared.value) if shared.value else None

            def clean(texts: pa.Array) -> np.ndarray:
                out = np.ones(len(texts), bool)
                if search:
                    out[search(texts)[1][0]] = False
                return out

            return clean

        out = filter_texts(out, text_col, make)
    return out


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every benchmark item stands in every document, in windows of 10 words."""
    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    n_hit = hit_words()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
