"""Lexical and dense ranking, and the fusion of rankings. All take and give tables of (query, item, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(scored: DataFrame, k: int, *order: Column, query: str = "query") -> DataFrame:
    """The first k rows of each query with their rank."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def postings(items: DataFrame, item: str, terms: Column) -> DataFrame:
    """(item, length, term, tf): the inverted index, length counting every term."""
    listed = items.select(F.col(item).alias("item"), terms.alias("terms"))
    flat = listed.select("item", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return flat.groupBy("item", "length", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, items: DataFrame, query: str, item: str, query_terms: Column, item_terms: Column, *, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, item, score) of all pairs that share a term. The join on terms is the index look-up; only query terms are shuffled."""
    asked = queries.select(F.col(query).alias("query"), F.explode(query_terms).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    sizes = items.select(F.size(item_terms).alias("n")).agg(F.count("*").alias("n_items"), F.avg("n").alias("mean_length"))
    index = postings(items, item, item_terms).join(asked.select("term").distinct(), "term", "left_semi")
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    n, mean = F.col("n_items"), F.col("mean_length")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    met = index.join(df, "term").join(asked, "term").crossJoin(F.broadcast(sizes))
    return met.groupBy("query", "item").agg(F.round(F.sum(F.col("qtf") * idf * weight), 8).alias("score"))


def coverage(queries: DataFrame, items: DataFrame, query: str, item: str, query_terms: Column, item_terms: Column, *, least_score: float = 0.2, least_overlap: int = 2) -> DataFrame:
    """(query, item, overlap, score): the share of the query's idf that an item's terms cover."""
    asked = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(query_terms)).alias("term"))
    index = postings(items, item, item_terms).select("item", "term").join(asked.select("term").distinct(), "term", "left_semi")
    n_items = items.agg(F.count("*").alias("n_items"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_items") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    known = asked.join(df, "term", "left").crossJoin(F.broadcast(n_items)).withColumn("idf", idf)
    whole = known.groupBy("query").agg(F.sum("idf").alias("whole"), F.count("*").alias("terms"))
    met = known.join(index, "term").groupBy("query", "item").agg(F.sum("idf").alias("covered"), F.count("*").alias("overlap"))
    scored = met.join(whole, "query").withColumn("score", F.round(F.col("covered") / F.col("whole"), 4))
    return scored.where((F.col("score") >= least_score) & (F.col("overlap") >= F.least(F.lit(least_overlap), "terms"))).select("query", "item", "overlap", "score")


def fused(first: DataFrame, second: DataFrame, weights: tuple[float, float], *, k: int = 60) -> DataFrame:
    """(query, item, best_rank, score, kind) of two rankings (query, item, rank): reciprocal ranks by weight. A list of weight 0 still brings candidates."""
    parts = [r.select("query", "item", "rank", F.lit(w).alias("w"), F.lit(i).alias("list")) for i, (r, w) in enumerate(zip((first, second), weights, strict=True))]
    both = parts[0].unionByName(parts[1]).groupBy("query", "item")
    one, two = F.max(F.col("list") == 0), F.max(F.col("list") == 1)
    out = both.agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 10).alias("score"), F.min("rank").alias("best_rank"), one.alias("one"), two.alias("two"))
    return out.select("query", "item", "best_rank", "score", F.when(F.col("one") & F.col("two"), "hybrid").when(F.col("one"), "first").otherwise("second").alias("kind"))
