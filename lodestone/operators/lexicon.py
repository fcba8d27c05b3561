"""Best items for a stated set of queries by their terms, without a row for each pair that shares one.

Queries are taken in blocks. One pass over the items finds a block's terms in them and writes only those, a row an item. From
that small table come the counts of items by term, and then each task scores its items against all queries of the block and
keeps the first k of each query. What is shuffled are those, so a term that stands in every item costs no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.sources.shared import written

#: Queries of a block, and cells of items and queries or terms that a task holds at a time.
BLOCK, CELLS = 1 << 12, 1 << 23


class Block:
    """A block's queries with their terms: term c is asked by queries[at[c] : at[c + 1]], each times as often."""

    def __init__(self, rows: list) -> None:
        self.queries = sorted({r.query for r in rows})
        self.terms = sorted({r.term for r in rows})
        number, code = {q: i for i, q in enumerate(self.queries)}, {t: i for i, t in enumerate(self.terms)}
        by = sorted((code[r.term], number[r.query], r.qtf) for r in rows)
        c, self.who, self.often = (np.array([x[i] for x in by], np.int64) for i in range(3))
        self.at = np.searchsorted(c, np.arange(len(self.terms) + 1))
        self.code = c

    def once(self) -> Block:
        """The block with every term of a query counted once."""
        other = copy(self)
        other.often = np.ones_like(self.often)
        return other


def found(terms: list[str]) -> Callable:
    """Each item's length and those of its terms that a block asks for, with their counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(terms, pa.string())
        for batch in batches:
            lists = batch.column(1)
            size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            code = pc.index_in(lists.drop_null().flatten().cast(pa.string()), value_set=words)
            known = code.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)[known]
            keys, tf = np.unique(row * max(1, len(terms)) + code.drop_null().to_numpy(zero_copy_only=False), return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(size) + 1) * max(1, len(terms))).astype(np.int32)
            as_list = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32)), as_list(keys % max(1, len(terms))), as_list(tf)], ["item", "length", "codes", "tfs"])

    return each


def best(block: Block, asker: pa.DataType, k: int, weigh: Callable, judge: Callable) -> Callable:
    """A task's first k items of each query: weigh gives a posting's weight, judge what becomes of summed weights and overlaps."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_q, kept, kind = len(block.queries), None, None
        step = max(1, CELLS // max(n_q, len(block.who), 1))
        for batch in batches:
            kind = batch.column(0).type
            item, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            codes, tf = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            ends = np.concatenate([[0], np.cumsum(size)])
            for a in range(0, len(item), step):
                b = min(len(item), a + step)
                c, t = codes[ends[a] : ends[b]], tf[ends[a] : ends[b]]
                row = np.repeat(np.arange(b - a), size[a:b])
                many = block.at[c + 1] - block.at[c]
                ask = np.repeat(block.at[c] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                cell = np.repeat(row, many) * n_q + block.who[ask]
                value = np.repeat(weigh(c, t, length[a:b][row]), many)
                sums = np.bincount(cell, value * block.often[ask], (b - a) * n_q)
                over = np.bincount(cell, minlength=(b - a) * n_q)
                hit = np.flatnonzero(over)
                q, who = hit % n_q, item[a:b][hit // n_q]
                score, fits = judge(q, sums[hit], over[hit])
                rows = [x[fits] for x in (q, who, score, over[hit])]
                kept = first_of_each(rows if kept is None else [np.concatenate(x) for x in zip(kept, rows)], k)
        if kept is not None and len(kept[0]):
            q, who, score, over = kept
            yield pa.RecordBatch.from_arrays([pa.array([block.queries[i] for i in q.tolist()], asker), pa.array(who, kind), pa.array(score), pa.array(over.astype(np.int64))], ["query", "item", "score", "overlap"])

    return each


def first_of_each(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, item, score, overlap) the first k of each query, by score, overlap and item."""
    q, item, score, over = rows
    by = np.lexsort([np.unique(item, return_inverse=True)[1], -over, -score, q])
    start = np.flatnonzero(np.append(True, q[by][1:] != q[by][:-1])) if len(by) else by
    place = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return [x[by[place < k]] for x in rows]


class Lexicon:
    """Items as a block of queries after another sees them.

    query_terms and item_terms are arrays of terms. Queries without terms find nothing. Items with a null id are left out, but count
    for the statistics; null terms are no terms. Null queries are left out.
    """

    def __init__(self, queries: DataFrame, items: DataFrame, query: str, item: str, query_terms: Column, item_terms: Column) -> None:
        asked = queries.where(F.col(query).isNotNull()).select(F.col(query).alias("query"), F.explode(query_terms).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
        self.asked = written(asked)
        self.kinds = {"query": self.asked.schema["query"].dataType, "item": items.schema[item].dataType}
        n = self.asked.select("query").distinct().count()
        self.blocks = []
        parts = max(1, -(-n // BLOCK))
        listed = items.select(F.col(item).alias("item"), item_terms.alias("terms"))
        for part in range(parts):
            block = Block(self.asked.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).collect() if parts > 1 else self.asked.collect())
            schema = T.StructType([T.StructField("item", self.kinds["item"]), T.StructField("length", T.IntegerType()), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
            self.blocks.append((block, written(listed.mapInArrow(found(block.terms), schema))))

    def statistics(self, block: Block, table: DataFrame) -> tuple[int, float, np.ndarray]:
        """Items, their mean length, and for each term of the block the items that hold it."""
        n, mean = table.agg(F.count("*"), F.avg("length")).head()
        counts = table.select(F.explode("codes").alias("c")).groupBy("c").agg(F.count("*").alias("df")).toArrow()
        df = np.zeros(len(block.terms), np.int64)
        df[counts.column("c").to_numpy()] = counts.column("df").to_numpy()
        return n, mean or 0.0, df

    def _ranked(self, k: int, made: Callable, *, once: bool = False) -> DataFrame:
        schema = T.StructType([T.StructField("query", self.kinds["query"]), T.StructField("item", self.kinds["item"]), T.StructField("score", T.DoubleType()), T.StructField("overlap", T.LongType())])
        parts = [table.where("item IS NOT NULL").mapInArrow(best(block, to_arrow_type(self.kinds["query"]), k, *made(block, *self.statistics(block, table))), schema) for block, table in ((b.once() if once else b, t) for b, t in self.blocks)]
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("overlap"), "item")
        return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def bm25(self, k: int, *, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query, item, score, rank): the first k items of each query, by score and item; items of score 0 are left out."""

        def made(block: Block, n: int, mean: float, df: np.ndarray) -> tuple[Callable, Callable]:
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
            weigh = lambda c, tf, length: idf[c] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))

            def judge(q: np.ndarray, sums: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                over[:] = 0  # ties go by item alone
                score = np.round(sums, 8)
                return score, score > 0

            return weigh, judge

        return self._ranked(k, made).select("query", "item", "score", "rank")

    def coverage(self, k: int, *, least_score: float = 0.2, least_overlap: int = 2) -> DataFrame:
        """(query, item, overlap, score, rank): the first k items by the share of the query's idf that their terms cover."""

        def made(block: Block, n: int, mean: float, df: np.ndarray) -> tuple[Callable, Callable]:
            idf = np.log((n + 1) / (df + 1)) + 1
            whole, terms = np.bincount(block.who, idf[block.code], len(block.queries)), np.bincount(block.who, minlength=len(block.queries))

            def judge(q: np.ndarray, sums: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                score = np.round(sums / whole[q], 4)
                return score, (score >= least_score) & (over >= np.minimum(least_overlap, terms[q]))

            return lambda c, tf, length: idf[c], judge

        return self._ranked(k, made, once=True).select("query", "item", "overlap", "score", "rank")
