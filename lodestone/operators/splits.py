"""Splits that keep groups of rows together and still meet a quota of rows for each source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.running import running_total
from lodestone.sources.shared import written


def components_of(rows: DataFrame, component: str, source: str, stratum: str) -> DataFrame:
    """(component, source, stratum, size) of rows: a component's most common stratum, the least of equally common ones.

    A component with rows of two sources, or of none, makes the job fail.
    """
    each = rows.groupBy(F.col(component).alias("component"), F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), F.min(source).alias("low"), F.max(source).alias("high"), F.count(source).alias("named"))
    by = each.groupBy("component").agg(F.min("low").alias("source"), F.max("high").alias("other"), F.sum("n").alias("size"), F.sum("named").alias("named"), F.min(F.struct(-F.col("n"), "stratum"))["stratum"].alias("stratum"))
    one = (F.col("source") == F.col("other")) & (F.col("named") == F.col("size"))
    say = F.concat(F.lit("SPLIT: not of one source: "), F.coalesce(F.col("component").cast("string"), F.lit("null")))
    return by.where(F.when(~F.coalesce(one, F.lit(False)), F.raise_error(say).cast("boolean")).otherwise(True)).select("component", "source", "stratum", "size")


def balanced_split(components: DataFrame, quotas: DataFrame, *, seed: str = "split") -> DataFrame:
    """components (component, source, stratum, size) with chosen: those whose rows make up their source's quota (source, quota).

    Each stratum of a source gives components in the order of a hash, as long as they fit its share of the quota, which is its
    share of the source's rows rounded down. What the strata leave is filled with the smallest components that remain.
    The chosen rows of a source never exceed its quota, and no component that is left out would fit besides: the quota
    is met within one component. Only running totals over ranges of components are needed, no order over all in one task.

    A source without a quota, or with a null or negative one, gives nothing; a quota above the source's rows takes all.
    """
    rows = components.join(quotas.groupBy("source").agg(F.max("quota").alias("quota")), "source", "left").withColumn("quota", F.coalesce("quota", F.lit(0)))
    drawn = rows.withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), F.col("component").cast("string")).cast("binary")))
    strata = components.groupBy("source", "stratum").agg(F.sum("size").alias("rows"))
    total = components.groupBy("source").agg(F.sum("size").alias("all_rows"))
    share = strata.join(total, "source").select(F.col("source").alias("s"), F.col("stratum").alias("h"), "rows", "all_rows")
    first = running_total(drawn, ["source", "stratum"], ["draw", "component"], "size", "upto")
    told = first.join(share, F.col("source").eqNullSafe(F.col("s")) & F.col("stratum").eqNullSafe(F.col("h")))
    taken = written(told.withColumn("taken", F.col("upto") <= F.floor(F.col("quota") * F.col("rows") / F.col("all_rows"))).drop("s", "h", "rows", "all_rows", "upto"))
    left = taken.groupBy("source").agg((F.max("quota") - F.coalesce(F.sum(F.when(F.col("taken"), F.col("size"))), F.lit(0))).alias("room"))
    filled = running_total(taken.where("NOT taken"), ["source"], ["size", "draw", "component"], "size", "upto")
    more = filled.join(left, "source").select(*components.columns, (F.col("upto") <= F.col("room")).alias("chosen"))
    return taken.where("taken").select(*components.columns, F.lit(True).alias("chosen")).unionByName(more)
