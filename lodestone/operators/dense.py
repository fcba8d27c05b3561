"""Exact dense ranking: a stated set of query vectors, in blocks, against all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that one pass broadcasts.
BLOCK = 4096


def nearest(queries: DataFrame, items: DataFrame, id_col: str, vector_col: str, k: int, *, block: int = BLOCK, least: float | None = None) -> DataFrame:
    """(query, item, rank, sim): each query's k items of the highest cosine, itself left out, ties by id.

    Each task keeps k candidates for each query of the block; their union is ranked. least drops what is less near, after the
    k are chosen. Vectors of no length, with null or non-finite components, or of another dimension than most are left out.
    """
    spark = items.sparkSession
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    named = items.select(F.col(id_col).alias("item"), F.col(vector_col).cast("array<double>").alias("vec")).where("vec is not null").where(finite)
    n = queries.count()
    parts = []
    asked = queries.select(F.col(id_col).alias("query"), F.col(vector_col).cast("array<double>").alias("vec")).where("vec is not null").where(finite)
    for b in range(max(1, -(-n // block))):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(max(1, -(-n // block)))) == b).collect()
        sizes = [len(r[1]) for r in rows]
        dim = max(set(sizes), key=sizes.count, default=0)
        rows = [r for r in rows if len(r[1]) == dim]
        ids, matrix = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            if not len(ids):
                return
            unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
            held_item, held_sim = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
            for df in batches:
                df = df[df["vec"].map(len) == matrix.shape[1]]
                if not len(df):
                    continue
                x = np.array(df["vec"].tolist(), float)
                sim = np.round(unit @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 8)
                item = np.broadcast_to(df["item"].to_numpy(), sim.shape)
                sim[ids[:, None] == item] = -np.inf
                item, sim = np.concatenate([held_item, item], axis=1), np.concatenate([held_sim, sim], axis=1)
                best = np.stack([np.lexsort((i, -s))[:k] for i, s in zip(item, sim, strict=True)])
                held_item, held_sim = np.take_along_axis(item, best, 1), np.take_along_axis(sim, best, 1)
            out = pd.DataFrame({"query": np.repeat(ids, held_item.shape[1]), "item": held_item.ravel(), "sim": held_sim.ravel()})
            yield out[np.isfinite(out["sim"])]

        parts.append(named.mapInPandas(run, "query long, item long, sim double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "item")))
    first = ranked.where(F.col("rank") <= k)
    return first if least is None else first.where(F.col("sim") >= least)
