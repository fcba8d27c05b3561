"""Statistics over grouped rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import written


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson's correlation by group; null for fewer than 3 pairs or no variance."""
    sums = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    r = F.when((F.col("n") >= 3) & (F.col("vx") > 0) & (F.col("vy") > 0), F.col("c") / F.sqrt(F.col("vx") * F.col("vy")))
    return sums.select(*keys, "n", r.alias("r"))


def holm(df: DataFrame, name: str, p: str) -> DataFrame:
    """Step-down adjusted p values over all rows: meant for a family of tests, one row each."""
    order = Window.orderBy(p, name)
    ranked = df.withColumn("i", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy()))
    raw = F.least(F.lit(1.0), (F.col("m") - F.col("i") + 1) * F.col(p))
    return ranked.withColumn("adjusted", F.max(raw).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("i", "m")


def kappa(df: DataFrame, a: str, b: str, classes: list) -> DataFrame:
    """Cohen's kappa of two ratings; undefined if chance alone agrees always."""
    n = F.count("*")
    agree = F.avg((F.col(a) == F.col(b)).cast("double"))
    chance = sum((F.avg((F.col(a) == c).cast("double")) * F.avg((F.col(b) == c).cast("double")) for c in classes), F.lit(0.0))
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(n.alias("n"), agree.alias("agreement"), chance.alias("chance")).withColumn("kappa", F.when(F.col("chance") < 1, (F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))))


def unequal_pairs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pairs of a group's rows, and how many of them differ, from counts and without a self-join."""
    each = df.groupBy(*keys, value).agg(F.count("*").alias("m"))
    pairs = lambda c: c * (c - 1) / 2
    total = each.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(pairs(F.col("m"))).alias("same"))
    return total.select(*keys, pairs(F.col("n")).cast("long").alias("pairs"), (pairs(F.col("n")) - F.col("same")).cast("long").alias("unequal"))


def draw(seed: str, *parts: Column) -> Column:
    """A 32-bit number from a seed and columns: the first 8 hexadecimal digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


#: The Poisson distribution of mean 1 at 0, 1, 2 ...
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def cluster_bootstrap(clusters: DataFrame, key: str, draws: int, seed: str) -> DataFrame:
    """Resampled means of clusters (key, total, size): (draw, mean).

    In each draw a cluster weighs as a Poisson number of mean 1 by hash, so that clusters are drawn apart from each other
    and no order over all of them is needed; sums are combined before they are shuffled.
    """
    each = clusters.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = draw(seed, F.col("draw"), F.col(key)) / F.lit(2.0**32)
    weighed = each.withColumn("w", sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0)))
    return weighed.groupBy("draw").agg((F.sum(F.col("w") * F.col("total")) / F.sum(F.col("w") * F.col("size"))).alias("mean"))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs; 1 where there are none. A fold of min(b, c) steps in logarithms."""
    n, k = b + c, F.least(b, c).cast("int")
    start = F.struct((-n * F.lit(math.log(2))).alias("log"), F.exp(-n * F.lit(math.log(2))).alias("tail"))

    def step(s: Column, i: Column) -> Column:
        log = s["log"] + F.log((n - i + 1) / i)
        return F.struct(log.alias("log"), (s["tail"] + F.exp(log)).alias("tail"))

    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step)["tail"]))


def weighted_kappa(rows: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """(n, agreement, kappa) of two ratings 1 .. levels with linear weights; null kappa where chance agrees fully."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    weight = lambda x, y: 1 - F.abs(x - y) / F.lit(float(levels - 1))
    total = cells.agg(F.sum("n").alias("total"), F.sum(F.col("n") * weight(F.col("a"), F.col("b"))).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.crossJoin(F.broadcast(right)).agg(F.sum(F.col("na") * F.col("nb") * weight(F.col("a"), F.col("b"))).alias("chance"))
    p, e = F.col("same") / F.col("total"), F.col("chance") / F.col("total") / F.col("total")
    return total.crossJoin(F.broadcast(chance)).select(F.col("total").alias("n"), p.alias("agreement"), F.when(e < 1, (p - e) / F.nullif(1 - e, F.lit(0.0))).alias("kappa"))


def quantiles(df: DataFrame, group: str, value: str, ps: list[float]) -> DataFrame:
    """(group, p, q): exact quantiles with linear interpolation at (n - 1) p; nulls are left out.

    Values are counted, dealt by ranges, and their running counts are summed over ranges, so that no task holds a group's
    distinct values, however many they are.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranged = written(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("g", "part").agg(F.sum("n").alias("m"))
    order = Window.partitionBy("g").orderBy("part")
    before = parts.select("g", "part", F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("g")).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    running = ranged.withColumn("upto", upto).join(before, ["g", "part"]).withColumn("upto", F.col("upto") + F.col("before")).withColumn("p", F.explode(F.array(*map(F.lit, ps))))
    at = (F.col("total") - 1) * F.col("p")
    holds = lambda i: F.max(F.when((F.col("upto") - F.col("n") <= i) & (i < F.col("upto")), F.col("v")))
    ends = running.groupBy("g", "p").agg(holds(F.floor(at)).alias("low"), holds(F.ceil(at)).alias("high"), F.max(at - F.floor(at)).alias("share"))
    return ends.select(F.col("g").alias(group), "p", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("q"))


def class_agreement(pairs: DataFrame, truth: str, guess: str, classes: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, class, support, predicted, hits, precision, recall, f1, n, accuracy, macro_f1, kappa): a candidate's classes against a reference's.

    A class that neither side has has no F1 and isn't in the mean; one that is never hit has 0. Kappa is null where chance
    alone agrees always. Pairs with a null are left out; every class of classes has a row, in each group that has pairs.
    One aggregation into the cells of the confusion matrix, of which there are as many as pairs of classes.
    """
    by = by or []
    names = F.array(*map(F.lit, classes))
    cells = pairs.where(F.col(truth).isin(*classes) & F.col(guess).isin(*classes)).groupBy(*by, F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("m"))
    each = cells.withColumn("class", F.explode(names))
    is_t, is_g = F.col("t") == F.col("class"), F.col("g") == F.col("class")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("m"))), F.lit(0))
    rows = each.groupBy(*by, "class").agg(total(is_t).alias("support"), total(is_g).alias("predicted"), total(is_t & is_g).alias("hits"), F.sum("m").alias("n"))
    f1 = F.when((F.col("support") > 0) | (F.col("predicted") > 0), 2 * F.col("hits") / (F.col("support") + F.col("predicted")))
    rows = rows.withColumn("precision", F.try_divide("hits", "predicted")).withColumn("recall", F.try_divide("hits", "support")).withColumn("f1", f1)
    group = Window.partitionBy(*by)
    n = F.col("n").cast("double")
    rows = rows.withColumn("accuracy", F.sum("hits").over(group) / n).withColumn("macro_f1", F.avg("f1").over(group)).withColumn("chance", F.sum(F.col("support") * F.col("predicted").cast("double")).over(group) / n / n)
    return rows.withColumn("kappa", F.when(F.col("chance") < 1, (F.col("accuracy") - F.col("chance")) / F.nullif(1 - F.col("chance"), F.lit(0.0)))).drop("chance")


def confusion(pairs: DataFrame, truth: str, guess: str, classes: list[str]) -> DataFrame:
    """(truth, guess, n): every cell of the confusion matrix, those without a pair too."""
    found = pairs.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))
    grid = pairs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, classes))).alias("truth")).select("truth", F.explode(F.array(*map(F.lit, classes))).alias("guess"))
    return grid.join(found, ["truth", "guess"], "left").select("truth", "guess", F.coalesce("n", F.lit(0)).alias("n"))
