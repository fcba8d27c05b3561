"""Queries of spoken formulas, which are made of parts' numbers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import spoken
from lodestone.registry import query, table


@query("""SELECT p_partkey, 'x_' || p_size || ' = (' || p_partkey || ' + a) / (2.' || p_size % 7 || '), v̄ ² × ' || p_partkey % 9 || CASE WHEN p_partkey % 3 = 0 THEN ' root of y' ELSE '' END AS shown, CASE WHEN p_partkey % 3 = 0 THEN 'low' ELSE 'medium' END AS trust FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'Δx = ' || p_size || '.5 m − ( − ' || p_partkey || ' ± 1) ³', 'high' FROM part WHERE p_partkey % 2 = 1""")
def p17_spoken_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas as they are read aloud, with signs again, and how far the result can be trusted."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    n = lambda c: c.cast("string")
    root = F.when(F.col("p_partkey") % 3 == 0, " root of y").otherwise("")
    even = F.concat(F.lit("x sub "), size, F.lit(" equals the fraction with numerator "), key, F.lit(" plus a and denominator 2 point "), n(F.col("p_size") % 7), F.lit(" comma v minus squared times "), n(F.col("p_partkey") % 9), root)
    odd = F.concat(F.lit("triangle x\n equals number "), size, F.lit(" point 5 minus m minus open paren negative "), key, F.lit(" plus or minus 1 close paren cubed"))
    rows = table(spark, sf_dir, "part").select("p_partkey", spoken.read_formula(F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd)).alias("f"))
    return rows.select("p_partkey", "f.shown", "f.trust")
