"""Operator 5: removal of repeated passages by suffix trees over groups of suffixes that share a prefix.

The suffixes that are gathered are sparse: those that begin with the k-gram that is the least, by hash, of some window. A
window that stands in two places has the same least k-gram in both, so both places belong to suffixes with a common
prefix. Each such suffix travels with the words of the windows that it stands for, once, instead of once for each word.

Prefixes have variable lengths. Suffixes form a group by their first k words, where no more than a given number of them do;
groups are dealt over as many buckets as keep each at a bounded size, whatever the corpus's size. Where more do, the prefix
is lengthened to the whole window: then all members of a group are alike, and Spark's aggregation keeps the first alone.

A bucket's suffixes, sorted, and the depths to which neighbours agree are its suffix tree. Internal nodes as deep as a
window are the repeats; a node's leaves are its places, of which all but the first are removed. Words of neighbouring
suffixes overlap, so the repeats of their nodes join to the maximal repeat when they are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACED, coded, col, gram_keys, hashed, map_texts, release, slices, staged, table, words

WINDOW = 20
#: Words of the k-grams by which suffixes are grouped.
GRAM = 5
#: Suffixes with which a group's prefix is lengthened to the window, and those of a bucket of groups.
GROUP, BUCKET = 1 << 12, 1 << 15
LEAST, MOST = np.uint64(0), np.uint64(2**64 - 1)
LOW_ID = np.iinfo(np.int64).min


def sliding(x: np.ndarray, n: int, pick: Callable) -> np.ndarray:
    """pick of each n neighbours, from each place on, for len(x) - n + 1 places."""
    done = 1
    while done * 2 <= n:
        x, done = pick(x[: len(x) - done], x[done:]), done * 2
    return pick(x[: len(x) - (n - done)], x[n - done :]) if done < n else x


class Suffixes:
    """The words of a slice's texts and the group of each of their windows."""

    def __init__(self, texts: pa.Array, window: int, gram: int) -> None:
        self.words, self.per_text, _ = words(texts, SPACED)
        n = len(self.words)
        self.row = np.repeat(np.arange(len(self.per_text) - 1), np.diff(self.per_text))
        end = self.per_text[1:][self.row]
        self.valid = np.arange(n) + window <= end
        self.group = np.zeros(n, np.uint64)
        self.least = np.zeros(0, np.uint64)
        if not self.valid.any():
            return
        codes, distinct = coded(self.words)
        self.keys = hashed(distinct)[codes]
        grams = np.append(gram_keys(self.keys, gram), np.full(gram - 1, MOST))
        grams[np.arange(n) + gram > end] = MOST
        wide = window - gram + 1
        m = sliding(grams, wide, np.minimum)
        self.group[: len(m)] = m
        self.group[~self.valid] = LEAST
        # places of k-grams that are the least of a window: those that the highest of their windows' least ones equals
        behind = np.concatenate([np.zeros(wide - 1, np.uint64), self.group])
        some = (sliding(behind, wide, np.maximum) == grams) & (grams != MOST)
        self.least, self.least_row = grams[some], self.row[some]

    def among(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which windows are in the groups that keys has for their text, and which of those groups are wide."""
        ends = pc.list_value_length(keys).fill_null(0).to_numpy(zero_copy_only=False)
        flat = keys.drop_null().flatten()
        key, wide = flat.field("key").to_numpy(zero_copy_only=False).view(np.uint64), flat.field("wide").to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(ends)), ends)
        by = np.lexsort([key, row])
        bound = np.searchsorted(row[by], np.arange(len(ends) + 1))
        inside, is_wide = np.zeros(len(self.group), bool), np.zeros(len(self.group), bool)
        for r in np.flatnonzero(ends).tolist():
            own, place = key[by[bound[r] : bound[r + 1]]], slice(self.per_text[r], self.per_text[r + 1])
            at = np.minimum(np.searchsorted(own, self.group[place]), len(own) - 1)
            inside[place] = own[at] == self.group[place]
            is_wide[place] = inside[place] & wide[by[bound[r] : bound[r + 1]]][at]
        return inside & self.valid, is_wide & self.valid


def group_keys(texts: pa.Array, window: int, gram: int) -> pa.Array:
    """Each text's groups, once for each place at which the group's k-gram is a window's least."""
    s = Suffixes(texts, window, gram)
    if not len(s.least):
        return pa.array([[]] * len(texts), pa.list_(pa.int64()))
    ends = np.concatenate([[0], np.cumsum(np.bincount(s.least_row, minlength=len(texts)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(s.least.view(np.int64)))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for size numbers each, one after another."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum())) if len(size) else np.zeros(0, np.int64)


STRETCHES = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "id", "hash", "start", "times")] + [T.StructField("stretch", T.StringType())])
WINDOWS = T.StructType([T.StructField(n, T.LongType()) for n in ("high", "low", "id", "hash", "start", "times")])
FIRSTS = "id long, hash long, start long, n long"


def places(batch: pa.RecordBatch, s: Suffixes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and hashes of the texts of words, and the words' numbers in their texts."""
    row = s.row[at]
    ids, hashes = batch.column(0).fill_null(LOW_ID).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    return ids[row], hashes[row], at - s.per_text[:-1][row]


def stretches(batch: pa.RecordBatch, window: int, gram: int) -> pa.RecordBatch:
    """The suffixes of repeated groups with their windows' words, for columns id, hash, text, keys; equal ones of the slice once."""
    s = Suffixes(batch.column(2), window, gram)
    inside, wide = s.among(batch.column(3))
    inside &= ~wide
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (s.group[1:] != s.group[:-1]) | (s.row[1:] != s.row[:-1])
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | new[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(stop)
    size = last - first + window
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), s.words.take(pa.array(spread(first, size)))), " ") if len(first) else pa.array([], pa.string())
    ids, hashes, start = places(batch, s, first)
    code = text.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    by = np.lexsort([start, hashes, ids, code])
    heads = np.flatnonzero(np.append(True, code[by][1:] != code[by][:-1])) if len(by) else by
    keep, times = by[heads], np.diff(np.append(heads, len(by)))
    columns = [s.group[first].view(np.int64)[keep], ids[keep], hashes[keep], start[keep], times]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), text.take(pa.array(keep)).cast(pa.string())], STRETCHES.names)


def windows(batch: pa.RecordBatch, window: int, gram: int) -> pa.RecordBatch:
    """The windows of wide groups by 128 bits of their words; equal ones of the slice once, at their first place."""
    s = Suffixes(batch.column(2), window, gram)
    at = np.flatnonzero(s.among(batch.column(3))[1])
    none = np.zeros(0, np.uint64)
    high, low = (gram_keys(s.keys ^ mask, window)[at] for mask in (LEAST, MOST)) if len(at) else (none, none)
    ids, hashes, start = places(batch, s, at)
    by = np.lexsort([start, hashes, ids, low, high])
    heads = np.flatnonzero(np.append(True, (high[by][1:] != high[by][:-1]) | (low[by][1:] != low[by][:-1]))) if len(by) else by
    columns = [x[by[heads]] for x in (high.view(np.int64), low.view(np.int64), ids, hashes, start)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.diff(np.append(heads, len(by))))], WINDOWS.names)


class Tree:
    """The suffix tree of a bucket, as far as its nodes are as deep as a window.

    leaves are the places of all suffixes in stretches, sorted by the window's words and equal ones by place. node has each
    leaf's node, the leaves that agree for a window or longer; head has each node's first leaf.
    """

    def __init__(self, letters: np.ndarray, at: np.ndarray, end: np.ndarray, order: list[np.ndarray], window: int) -> None:
        bits = max(1, int(letters.max(initial=0)).bit_length())
        each = 63 // bits
        columns = []
        for base in range(0, window, each):
            column = np.zeros(len(at), np.int64)
            for depth in range(base, min(window, base + each)):
                column = (column << bits) | letters[at + depth]
            columns.append(column)
        self.leaves = np.lexsort([*order, *columns[::-1]])
        above = np.ones(len(at), bool)  # whether a leaf and the one before part above the window's depth
        for column in columns:
            own = column[self.leaves]
            above[1:] &= own[1:] == own[:-1]
        above[1:] = ~above[1:]
        self.node = np.cumsum(above) - 1
        self.head = np.flatnonzero(above)
        self.letters, self.at, self.end, self.window = letters, at, end, window

    def sizes(self) -> np.ndarray:
        """The leaves of each node."""
        return np.diff(np.append(self.head, len(self.at)))

    def depths(self) -> np.ndarray:
        """The words to which all leaves of each node agree, as far as their stretches reach: the node's depth."""
        letters, at, end = self.letters, self.at, self.end
        # neighbours of a node agree further: until their words differ, or a stretch ends
        here = np.flatnonzero(np.append(False, self.node[1:] == self.node[:-1]))
        left, right = self.leaves[here - 1], self.leaves[here]
        reach = np.minimum(end[left] - at[left], end[right] - at[right])
        agree, open_ = np.full(len(here), self.window), np.flatnonzero(reach > self.window)
        while len(open_):
            same = letters[at[left[open_]] + agree[open_]] == letters[at[right[open_]] + agree[open_]]
            open_ = open_[same]
            agree[open_] += 1
            open_ = open_[agree[open_] < reach[open_]]
        alone = end[self.leaves[self.head]] - at[self.leaves[self.head]]  # a leaf of its own is as deep as its stretch
        depth = np.where(self.sizes() > 1, np.iinfo(np.int64).max, alone)
        np.minimum.at(depth, self.node[here], agree)
        return depth


def planted(group: pa.Table, window: int) -> tuple[Tree, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree of a bucket's stretches, and of each of its suffixes the text's id, hash and number, the place in it, and the stretch."""
    text = group.column("stretch").combine_chunks()
    array, per_text, _ = words(text, SPACED)
    letters = coded(array)[0].astype(np.int64)
    many = np.diff(per_text) - window + 1
    at = spread(per_text[:-1], many)
    row = np.repeat(np.arange(len(many)), many)
    ids, hashes, start = (group.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in ("id", "hash", "start"))
    _, doc = np.unique(np.stack([ids, hashes], 1), axis=0, return_inverse=True)
    doc = doc.reshape(-1)[row]
    place = start[row] + at - per_text[:-1][row]
    return Tree(letters, at, per_text[1:][row], [place, doc], window), ids[row], hashes[row], doc, place, row


def first_places(group: pa.Table, window: int) -> pa.Table:
    """Of all windows in a bucket's stretches, the places where a word sequence stands first, as runs (id, hash, start, n)."""
    tree, ids, hashes, doc, place, _ = planted(group, window)
    chosen = tree.leaves[tree.head]  # a node's first leaf in order of place
    by = chosen[np.lexsort([place[chosen], doc[chosen]])]
    new = np.append(True, (doc[by][1:] != doc[by][:-1]) | (place[by][1:] > place[by][:-1] + 1))
    head = by[new]
    starts = np.flatnonzero(new)
    last = by[np.append(starts[1:], len(by)) - 1]
    return pa.table({"id": ids[head], "hash": hashes[head], "start": place[head], "n": place[last] - place[head] + 1})


def deep_nodes(group: pa.Table, window: int) -> pa.Table:
    """The nodes of a bucket's tree with more than one place: the first ones and the nodes' depths."""
    tree, ids, hashes, _, place, row = planted(group, window)
    times = group.column("times").combine_chunks().to_numpy(zero_copy_only=False)[row]
    some = np.add.reduceat(times[tree.leaves], tree.head) > 1
    first = tree.leaves[tree.head][some]
    return pa.table({"id": ids[first], "hash": hashes[first], "start": place[first], "n": tree.depths()[some]})


KEPT = "n_words long, removed array<struct<start:long,words:long>>, kept_text string"


def gathered(docs: DataFrame, window: int, gram: int, group: int, bucket: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts with the keys of their repeated groups, stretches with their bucket, and windows of wide groups with their first place p and times."""
    named = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).withColumn("hash", F.xxhash64("text")).select("id", "hash", "text")
    keyed = map_texts(named, "text", ["id", "hash"], [T.StructField("keys", T.ArrayType(T.LongType()))], lambda: lambda texts: [group_keys(texts, window, gram)])
    keys = keyed.select(F.coalesce("id", F.lit(LOW_ID)).alias("id"), "hash", F.explode("keys").alias("key"))
    # written before it is joined, so that Spark can split the rows of a key that very many texts have
    repeated = staged(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = repeated.where(F.col("n") <= group).agg(F.sum("n")).head()[0] or 0
    marked = keys.join(repeated.select("key", (F.col("n") > group).alias("wide")), "key")
    per_doc = marked.groupBy("id", "hash").agg(F.collect_set(F.struct("key", "wide")).alias("keys"))
    per_doc = staged(per_doc.select(F.col("id").alias("kid"), F.col("hash").alias("khash"), "keys"))
    release(repeated)
    texts = named.select(F.coalesce("id", F.lit(LOW_ID)).alias("id"), "hash", "text", F.col("id").isNull().alias("no_id"))
    with_keys = texts.join(per_doc.hint("shuffle_hash"), (F.col("id") == F.col("kid")) & (F.col("hash") == F.col("khash")), "left")

    def gather(make: Callable) -> Callable:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    yield make(part, window, gram)
            pa.default_memory_pool().release_unused()

        return each

    some = lambda wide: with_keys.where(F.exists("keys", lambda k: k["wide"] == wide)).select("id", "hash", "text", "keys")
    buckets = max(1, -(-members // bucket))
    near = some(False).mapInArrow(gather(stretches), STRETCHES).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    far = some(True).mapInArrow(gather(windows), WINDOWS).groupBy("high", "low").agg(F.min(F.struct("id", "hash", "start")).alias("p"), F.sum("times").alias("times"))
    return with_keys, near, far


def without_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, removed, kept_text), one row per row of docs: words under a window that stands earlier are removed.

    Words stand between ASCII white space, as they are. A window is window consecutive words of one text; it is removed if
    its words also begin earlier, by smaller id, then smaller hash of the text, then start. removed has the runs of removed
    words; kept_text is the others, joined by one blank. Within a bucket words are compared as they are; windows of groups
    with more than group members are the same if 128 bits of their words are.

    Null text: no words, empty kept text. Texts shorter than a window are kept. Rows alike in id and text are one document
    and are treated alike; rows that share only an id are documents of their own. Null ids come first. Very long texts are
    read whole. No rows: none come out. Ids are integers. Further columns, whatever their names, are left out.
    """
    with_keys, near, far = gathered(docs, window, gram, group, bucket, id_col, text_col)
    firsts = near.groupBy("bucket").applyInArrow(lambda t: first_places(t, window), FIRSTS)
    firsts = firsts.unionByName(far.select("p.id", "p.hash", "p.start", F.lit(1).cast("long").alias("n")))
    per_text = firsts.groupBy(F.col("id").alias("fid"), F.col("hash").alias("fhash")).agg(F.collect_list(F.struct("start", "n")).alias("firsts"))
    whole = with_keys.join(per_text.hint("shuffle_hash"), (F.col("id") == F.col("fid")) & (F.col("hash") == F.col("fhash")), "left")
    schema = T.StructType([T.StructField(id_col, T.LongType()), *T._parse_datatype_string(KEPT).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield kept_of(part, window, gram, schema.names)
        pa.default_memory_pool().release_unused()

    return whole.select(F.when(~F.col("no_id"), F.col("id")).alias("id"), "hash", "text", "keys", "firsts").mapInArrow(cut, schema)


def repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, words): the first place of every word sequence of window words or more that stands in two places, by group.

    These are the trees' deep internal nodes, with their depths; of a group whose prefix was lengthened to the window they
    are as deep as the window. A sequence that reaches over several suffixes has a node at each, which overlap. For texts
    and ids see without_repeats; each of rows alike in id and text is a place.
    """
    _, near, far = gathered(docs, window, gram, group, bucket, id_col, text_col)
    nodes = near.groupBy("bucket").applyInArrow(lambda t: deep_nodes(t, window), FIRSTS)
    nodes = nodes.unionByName(far.where("times > 1").select("p.id", "p.hash", "p.start", F.lit(window).cast("long").alias("n")))
    return nodes.select(F.when(F.col("id") != LOW_ID, F.col("id")).alias(id_col), "start", F.col("n").alias("words"))


def kept_of(batch: pa.RecordBatch, window: int, gram: int, names: list[str]) -> pa.RecordBatch:
    """The kept words of each text: of its windows in repeated groups, those that don't stand first are removed."""
    s = Suffixes(batch.column(2), window, gram)
    inside, _ = s.among(batch.column(3))
    firsts = batch.column(4)
    size = pc.list_value_length(firsts).fill_null(0).to_numpy(zero_copy_only=False)
    flat = firsts.drop_null().flatten()
    begin = s.per_text[:-1][np.repeat(np.arange(len(size)), size)] + flat.field("start").to_numpy(zero_copy_only=False)
    n = len(s.words)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + flat.field("n").to_numpy(zero_copy_only=False), -1)
    again = np.flatnonzero(inside & (np.cumsum(change)[:-1] <= 0))
    change[:] = 0
    np.add.at(change, again, 1)
    np.add.at(change, again + window, -1)
    out = np.cumsum(change)[:-1] > 0
    kept = np.flatnonzero(~out)
    n_kept = np.bincount(s.row[kept], minlength=batch.num_rows)
    ends = np.concatenate([[0], np.cumsum(n_kept)])
    text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), s.words.take(pa.array(kept)).cast(pa.large_string())), pa.scalar(" ", pa.large_string())).cast(pa.string())
    new = out.copy()
    new[1:] &= ~out[:-1] | (s.row[1:] != s.row[:-1])
    head = np.flatnonzero(new)
    run = np.add.reduceat(out.astype(np.int64), head) if len(head) else head
    spans = pa.StructArray.from_arrays([pa.array(head - s.per_text[:-1][s.row[head]]), pa.array(run)], ["start", "words"])
    span_ends = np.concatenate([[0], np.cumsum(np.bincount(s.row[head], minlength=batch.num_rows))]).astype(np.int32)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(s.per_text)), pa.ListArray.from_arrays(pa.array(span_ends), spans), text], names)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows of 20 words that stand earlier in the corpus."""
    kept = without_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["words"])
    return kept.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
