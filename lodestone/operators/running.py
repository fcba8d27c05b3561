"""Running totals within groups that no task has to hold whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import written


def running_total(rows: DataFrame, group: list[str], order: list[str], value: str | None, name: str) -> DataFrame:
    """rows with the sum of value up to and with each row in its group's order; without value, the row's number from 1.

    Rows are dealt by ranges of group and order, each range is summed, and sums over ranges are added: a group that holds a third
    of all rows is spread over as many tasks as its rows need. order must tell a group's rows apart, or their totals can
    be anyone's. A null value counts 0; null groups are a group.
    """
    ranged = written(rows.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    own = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(1).cast("long")
    parts = ranged.groupBy(*group, "__part").agg(F.sum(own).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum(own).over(Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)]
    met = ranged.withColumn("__within", within).join(offsets, [*same, F.col("__part") == F.col("__p")])
    return met.select(*rows.columns, (F.col("__within") + F.col("__before")).alias(name))
