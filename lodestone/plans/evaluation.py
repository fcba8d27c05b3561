"""Queries of reports and statistics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import stats
from lodestone.operators.metrics import share
from lodestone.registry import query, table


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS numerator, count(o_orderstatus)::BIGINT AS denominator, round(count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(o_orderstatus), 0), 8) AS value FROM orders GROUP BY 1")
def m15_bool_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    num, den, value = share(F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(num, den, value).withColumn("value", F.round("value", 8))


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())")
def m20_m34_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    return cube.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price")).select("o_orderstatus", "o_orderpriority", "level", "n", "mean_price")


@query("""SELECT q.v AS quality, t.v AS toxic, coalesce(n, 0)::BIGINT AS n FROM (VALUES (0), (1)) q(v) CROSS JOIN (VALUES (0), (1)) t(v)
LEFT JOIN (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL) l ON l.quality = q.v AND l.toxic = t.v""")
def m17_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of both labels, with cells of none."""
    grid = spark.range(2).select(F.col("id").cast("int").alias("quality")).crossJoin(spark.range(2).select(F.col("id").cast("int").alias("toxic")))
    counts = table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return grid.join(counts, ["quality", "toxic"], "left").select("quality", "toxic", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""WITH c AS (SELECT o_orderpriority, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1)
SELECT o_orderpriority, round(f, 4) AS f_price, round(o, 4) AS o_price, round(f - o, 4) AS delta FROM c""")
def m23_pivot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).avg("o_totalprice")
    return wide.select("o_orderpriority", F.round("F", 4).alias("f_price"), F.round("O", 4).alias("o_price"), F.round(F.col("F") - F.col("O"), 4).alias("delta"))


@query("""SELECT lang, count(*)::BIGINT AS n, round(count(*) FILTER (WHERE quality = 1) / count(*), 8) AS lower_bound, round(count(*) FILTER (WHERE quality = 1 OR quality IS NULL) / count(*), 8) AS upper_bound
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY lang""")
def m30_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate's bounds: documents without a label count as bad, then as good."""
    label = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(label, "doc_id", "left").groupBy("lang")
    good = F.count_if(F.col("quality") == 1)
    return rows.agg(F.count("*").alias("n"), F.round(good / F.count("*"), 8).alias("lower_bound"), F.round((good + F.count_if(F.col("quality").isNull())) / F.count("*"), 8).alias("upper_bound"))


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95, round(quantile_cont(abs(value), 0.5), 6) AS abs_q50 FROM events GROUP BY 1")
def q1_q22_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    signed = stats.quantiles(events, "event_type", "value", [0.05, 0.25, 0.5, 0.95])
    size = stats.quantiles(events.select("event_type", F.abs("value").alias("size")), "event_type", "size", [0.5]).withColumn("p", F.lit(-1.0))
    pick = lambda p, name: F.round(F.max(F.when(F.col("p") == p, F.col("q"))), 6).alias(name)
    found = signed.unionByName(size).groupBy("event_type").agg(pick(0.05, "q05"), pick(0.25, "q25"), pick(0.5, "q50"), pick(0.95, "q95"), pick(-1.0, "abs_q50"))
    return events.select("event_type").distinct().join(found, "event_type", "left")


@query("""SELECT l_returnflag, count(*)::BIGINT AS n, round(CASE WHEN count(*) >= 3 AND var_pop(l_quantity) > 0 AND var_pop(l_extendedprice) > 0 THEN covar_pop(l_quantity, l_extendedprice) / sqrt(var_pop(l_quantity) * var_pop(l_extendedprice)) END, 8) AS r FROM lineitem GROUP BY 1""")
def q13_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 8))


@query("""WITH e AS (SELECT user_id, event_type, count(*) AS m FROM events GROUP BY ALL), t AS (SELECT user_id, sum(m) AS n, sum(m * (m - 1) // 2) AS same FROM e GROUP BY user_id)
SELECT user_id, (n * (n - 1) // 2)::BIGINT AS pairs, (n * (n - 1) // 2 - same)::BIGINT AS unequal FROM t""")
def q20_pair_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.unequal_pairs(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""WITH s AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS a, avg((quality = 0)::INT) * avg((toxic = 0)::INT) + avg((quality = 1)::INT) * avg((toxic = 1)::INT) AS c FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT n::BIGINT AS n, round(a, 8) AS agreement, round(CASE WHEN c < 1 THEN (a - c) / (1 - c) END, 8) AS kappa FROM s""")
def q11_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = stats.kappa(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])
    return row.select("n", F.round("agreement", 8).alias("agreement"), F.round("kappa", 8).alias("kappa"))


@query("""WITH c AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS total, count(*) AS size FROM orders GROUP BY o_custkey),
u AS (SELECT d.draw, total, size, ('0x' || substr(md5('boot|' || d.draw || '|' || o_custkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM range(200) d(draw), c),
w AS (SELECT *, (u >= 0.36787944::DOUBLE)::INT + (u >= 0.73575888::DOUBLE)::INT + (u >= 0.91969860::DOUBLE)::INT + (u >= 0.98101184::DOUBLE)::INT + (u >= 0.99634015::DOUBLE)::INT + (u >= 0.99940582::DOUBLE)::INT + (u >= 0.99991676::DOUBLE)::INT AS w FROM u),
m AS (SELECT draw, sum(w * total) / sum(w * size) AS mean FROM w GROUP BY draw)
SELECT count(*)::BIGINT AS draws, round(quantile_cont(mean, 0.025), 8) AS low, round(quantile_cont(mean, 0.975), 8) AS high FROM m""")
def q2_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the finished orders' share, customers weighed as clusters, 200 times."""
    clusters = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("total"), F.count("*").alias("size"))
    means = stats.cluster_bootstrap(clusters, "o_custkey", 200, "boot")
    return means.agg(F.count("*").alias("draws"), F.round(F.percentile("mean", 0.025), 8).alias("low"), F.round(F.percentile("mean", 0.975), 8).alias("high"))


@query("""WITH t AS (SELECT o_orderpriority AS name, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS p FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM t)
SELECT name, round(p, 8) AS p, round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 8) AS adjusted FROM r""")
def q6_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down adjustment of one number for each priority."""
    tests = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("p"))
    return stats.holm(tests, "name", "p").select("name", F.round("p", 8).alias("p"), F.round("adjusted", 8).alias("adjusted"))


@query("""WITH c AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS a, avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS b FROM orders GROUP BY 1)
SELECT count(*)::BIGINT AS clusters, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL)::BIGINT AS pairs, count(*) FILTER (WHERE (a IS NULL) <> (b IS NULL))::BIGINT AS missing, round(avg(a - b), 4) AS difference FROM c""")
def q4_paired_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = lambda p: F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice")))
    arms = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(arm("1-URGENT").alias("a"), arm("5-LOW").alias("b"))
    a, b = F.col("a").isNull(), F.col("b").isNull()
    return arms.agg(F.count("*").alias("clusters"), F.count_if(~a & ~b).alias("pairs"), F.count_if(a != b).alias("missing"), F.round(F.avg(F.col("a") - F.col("b")), 4).alias("difference"))
