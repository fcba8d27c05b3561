"""Queries of evidence ranks, weight grids, span overlaps, coverage, agreement and choices."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import long_words
from lodestone.operators import joins, ranking, stats
from lodestone.operators.spans import line_spans
from lodestone.plans.corpus import LINES
from lodestone.operators.ranking import placed_in_groups
from lodestone.registry import query, table


@query("""WITH s AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_suppkey % 3 AS c, CASE WHEN count(CASE WHEN l_quantity <= 45 THEN l_linenumber END) = count(*) THEN max(l_linenumber) END AS r FROM lineitem GROUP BY ALL),
p AS (SELECT l_orderkey, l_returnflag, l_linestatus, min(r) AS r FROM s GROUP BY ALL),
q AS (SELECT l_orderkey, l_returnflag, CASE WHEN count(r) = count(*) THEN max(r) END AS r FROM p GROUP BY ALL)
SELECT l_orderkey, min(r) AS complete_rank FROM q GROUP BY ALL""")
def m2_complete_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rank with all of some path: orders' lines by flag (path), status (span) and supplier (set)."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", (F.col("l_suppkey") % 3).alias("c"), F.when(F.col("l_quantity") <= 45, F.col("l_linenumber")).alias("rank"))
    return ranking.complete_rank(rows, "l_orderkey", "l_returnflag", "l_linestatus", "c", "rank")


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN max(l_quantity) OVER w = min(l_quantity) OVER w THEN 1.0 ELSE (l_quantity - min(l_quantity) OVER w) / nullif(max(l_quantity) OVER w - min(l_quantity) OVER w, 0) END, 8) AS score
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def k1_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(ranking.min_max(F.col("l_quantity"), "l_orderkey"), 8).alias("score"))


GRID = """r AS (SELECT w.weight, l_orderkey, l_returnflag = 'R' AS rel, row_number() OVER (PARTITION BY w.weight, l_orderkey ORDER BY round((1 - w.weight) * (l_quantity / 50) + w.weight * (l_linestatus = 'F')::INT, 9) DESC, l_linenumber, l_partkey, l_returnflag) AS place
FROM lineitem, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) w(weight)),
f AS (SELECT weight, l_orderkey, min(CASE WHEN rel THEN place END) AS first FROM r GROUP BY ALL),
g AS (SELECT weight, count(*)::BIGINT AS n, avg(coalesce(1 / first, 0)) AS mrr, avg(coalesce((first <= 2)::INT, 0)) AS hit FROM f GROUP BY ALL)"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, c = table(spark, sf_dir, "lineitem"), F.col
    return ranking.on_grid(lines, [0, 0.1, 0.2, 0.5, 1], "l_orderkey", c("l_quantity") / 50, (c("l_linestatus") == "F").cast("int"), c("l_returnflag") == "R", ["l_linenumber", "l_partkey", "l_returnflag"], 2)


@query(f"WITH {GRID} SELECT weight, n, round(mrr, 8) AS mrr, round(hit, 8) AS hit FROM g")
def k5_weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir).select("weight", "n", F.round("mrr", 8).alias("mrr"), F.round("hit", 8).alias("hit"))


@query(f"WITH {GRID} SELECT weight, n, round(mrr, 8) AS mrr, round(hit, 8) AS hit FROM g ORDER BY round(mrr, 9) DESC, round(hit, 9) DESC, weight LIMIT 1")
def k6_best_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.best_weight(weights(spark, sf_dir)).select("weight", "n", F.round("mrr", 8).alias("mrr"), F.round("hit", 8).alias("hit"))


@query(f"WITH {GRID} SELECT max(weight) AS weight FROM g WHERE weight > 0 AND hit >= (SELECT hit FROM g WHERE weight = 0) - 0.01 - 1e-12")
def k8_largest_harmless_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.largest_harmless(weights(spark, sf_dir), 0.01)


@query("""WITH m AS (SELECT o_custkey, o_orderdate, o_totalprice >= lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up FROM orders)
SELECT o_custkey, count(*)::BIGINT AS n, coalesce(bool_and(up), true) AS monotone FROM m GROUP BY 1""")
def k11_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer's order values never fall."""
    last = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("up", F.col("o_totalprice") >= last)
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.coalesce(F.bool_and("up"), F.lit(True)).alias("monotone"))


@query(f"""WITH {LINES}, o AS (SELECT doc_id, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(line) AS n FROM lines),
p AS (SELECT doc_id, unnest(range(0, length(text), 256)) AS b FROM documents WHERE length(text) > 0)
SELECT doc_id, CASE WHEN s = b AND s + n = b + 256 THEN 'exact' WHEN s <= b AND s + n >= b + 256 THEN 'contains' WHEN s >= b AND s + n <= b + 256 THEN 'within' ELSE 'partial' END AS overlap, count(*)::BIGINT AS n
FROM o JOIN p USING (doc_id) WHERE n > 0 AND s < b + 256 AND b < s + n GROUP BY ALL""")
def j5_g1_line_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the lines of documents lie to their windows of 256 characters."""
    docs = table(spark, sf_dir, "documents")
    windows = docs.where(F.char_length("text") > 0).select(F.col("doc_id").alias("doc"), F.explode(F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(256))).alias("other_start")).withColumn("other_end", F.col("other_start") + 256)
    met = joins.overlapping(line_spans(docs).drop("line"), windows, ["doc"], 256)
    named = met.select(F.col("doc").alias("doc_id"), joins.overlap_class(*map(F.col, ("start", "end", "other_start", "other_end"))).alias("overlap"))
    return named.groupBy("doc_id", "overlap").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT n_nationkey AS nation, s.seg FROM nation, (SELECT DISTINCT c_mktsegment AS seg FROM customer) s), f AS (SELECT DISTINCT c_nationkey AS nation, CASE WHEN c_custkey % 50 = 0 THEN 'OTHER' ELSE c_mktsegment END AS seg FROM customer WHERE c_acctbal > 8500)
SELECT nation, seg, 'missing' AS state FROM (SELECT * FROM e EXCEPT SELECT * FROM f) UNION ALL SELECT nation, seg, 'unexpected' FROM (SELECT * FROM f EXCEPT SELECT * FROM e)""")
def j3_m24_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of nation and segment without a customer of much credit, and cells that none expects."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("seg"), "c_acctbal")
    expected = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")).crossJoin(F.broadcast(customers.select("seg").distinct()))
    found = table(spark, sf_dir, "customer").where("c_acctbal > 8500").select(F.col("c_nationkey").alias("nation"), F.when(F.col("c_custkey") % 50 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("seg"))
    return joins.coverage(expected, found, ["nation", "seg"])


@query("""WITH u AS (SELECT o_orderkey, o_orderstatus AS s FROM orders UNION ALL SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END FROM lineitem GROUP BY 1)
SELECT o_orderkey, count(*)::BIGINT AS copies, count(DISTINCT s) > 1 AS conflict FROM u GROUP BY 1""")
def d5_ledger_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' status by themselves and by their lines: copies and conflicts."""
    all_of = lambda s: F.bool_and(F.col("l_linestatus") == s)
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(all_of("F"), "F").when(all_of("O"), "O").otherwise("P").alias("s"))
    return joins.merged_ledgers([table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s")), lines], "o_orderkey")


@query("""WITH v AS (SELECT lower(p_brand) AS brand, p_type AS variant, count(*) AS n FROM part GROUP BY ALL)
SELECT brand, variant, n::BIGINT AS n FROM v QUALIFY row_number() OVER (PARTITION BY brand ORDER BY n DESC, lower(variant), variant) = 1""")
def d9_commonest_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("brand"), F.col("p_type").alias("variant")).agg(F.count("*").alias("n"))
    best = Window.partitionBy("brand").orderBy(F.desc("n"), F.lower("variant"), "variant")
    return counts.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


@query("""WITH t AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, b::BIGINT AS b, c::BIGINT AS c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM unnest(range(0, least(b, c) + 1)) x(i))) END, 8) AS p FROM t""")
def q8_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang")
    counts = rows.agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("b"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("c"))
    return counts.withColumn("p", F.round(stats.mcnemar(F.col("b"), F.col("c")), 8))


RATED = "o AS (SELECT substr(o_orderpriority, 1, 1)::INT AS a, least(5, 1 + floor(o_totalprice / 100000))::INT AS b FROM orders)"


@query(f"""WITH {RATED}, c AS (SELECT a, b, count(*) AS n FROM o GROUP BY ALL), x AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), y AS (SELECT b, sum(n) AS n FROM c GROUP BY 1),
s AS (SELECT sum(n) AS n, sum(n * (1 - abs(a - b) / 4.0::DOUBLE)) AS same FROM c), e AS (SELECT sum(x.n * y.n * (1 - abs(a - b) / 4.0::DOUBLE)) AS chance FROM x, y)
SELECT n::BIGINT AS n, round(same / n, 8) AS agreement, round((same / n - chance / n / n) / (1 - chance / n / n), 8) AS kappa FROM s, e""")
def q12_weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("a"), F.least(F.lit(5), 1 + F.floor(F.col("o_totalprice") / 100000)).cast("int").alias("b"))
    return stats.weighted_kappa(rated, "a", "b", 5).select("n", F.round("agreement", 8).alias("agreement"), F.round("kappa", 8).alias("kappa"))


@query("""WITH g AS (SELECT text, source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
SELECT source, count(*)::BIGINT AS groups, round(avg((langs = 1)::INT), 8) AS consistent FROM g GROUP BY source""")
def q16_copy_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of groups of equal texts that have one language."""
    groups = table(spark, sf_dir, "documents").where("text is not null").groupBy("source", F.sha2("text", 256).alias("t")).agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs")).where("n > 1")
    return groups.groupBy("source").agg(F.count("*").alias("groups"), F.round(F.avg((F.col("langs") == 1).cast("int")), 8).alias("consistent"))


@query("SELECT l_orderkey, sha256(string_agg(l_returnflag || ':' || l_partkey, ',' ORDER BY l_returnflag || ':' || l_partkey)) AS signature FROM lineitem GROUP BY 1")
def q18_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each order's decisions, whatever their order."""
    parts = F.array_sort(F.collect_list(F.concat("l_returnflag", F.lit(":"), F.col("l_partkey").cast("string"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.concat_ws(",", parts), 256).alias("signature"))


@query("""WITH d AS (SELECT user_id, avg(value) FILTER (WHERE event_id % 2 = 0) - avg(value) FILTER (WHERE event_id % 2 = 1) AS d FROM events GROUP BY 1)
SELECT count(d)::BIGINT AS n, round(sqrt(avg(d * d) / nullif(count(d), 0)), 8) AS floor FROM d""")
def q24_noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda i: F.avg(F.when(F.col("event_id") % 2 == i, F.col("value")))
    d = table(spark, sf_dir, "events").groupBy("user_id").agg((half(0) - half(1)).alias("d"))
    return d.agg(F.count("d").alias("n"), F.round(F.sqrt(F.try_divide(F.avg(F.col("d") * F.col("d")), F.count("d"))), 8).alias("floor"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS f, count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS o, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS p FROM orders GROUP BY 1""")
def m28_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return made.select("o_orderpriority", *[F.col(s).alias(s.lower()) for s in "FOP"])


@query("SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def m18_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT lang, count(*) FILTER (WHERE n_chars < 200 AND quality = 0) AS tp, count(*) FILTER (WHERE n_chars < 200) AS said, count(*) FILTER (WHERE quality = 0) AS pos FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, round(tp / nullif(said, 0), 8) AS prec, round(tp / nullif(pos, 0), 8) AS recall, round(CASE WHEN pos > 0 THEN 2 * tp / nullif(said + pos, 0) END, 8) AS f1 FROM t""")
def m16_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts as a guess at poor quality; undefined values are null."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") < 200).alias("said")).join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("pos")), "doc_id")
    t = rows.groupBy("lang").agg(F.count_if(F.col("said") & F.col("pos")).alias("tp"), F.count_if("said").alias("said"), F.count_if("pos").alias("pos"))
    d = lambda a, b: F.round(F.try_divide(a, b), 8)
    return t.select("lang", d(F.col("tp"), F.col("said")).alias("prec"), d(F.col("tp"), F.col("pos")).alias("recall"), F.when(F.col("pos") > 0, d(2 * F.col("tp"), F.col("said") + F.col("pos"))).alias("f1"))


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT DISTINCT source, doc_id FROM r JOIN (SELECT unnest(range(5)) AS s) ON i = round_even(s * (n - 1) / 4.0, 0)""")
def c11_even_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each source, evenly spaced by id (a sampling report)."""
    rows = placed_in_groups(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")
    at = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda s: F.bround(s * (F.col("size") - 1) / 4.0, 0).cast("long"))
    return rows.where(F.array_contains(at, F.col("place") - 1)).select("source", "doc_id")


@query("""WITH r AS (SELECT user_id, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS s, sum(value) OVER (PARTITION BY user_id) AS t FROM events WHERE value > 0)
SELECT user_id, min(event_id) AS event_id FROM r WHERE s > 0.37 * t GROUP BY 1""")
def o9_weighted_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of each user that a draw of 0.37 falls on, events weighed by value."""
    w = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").where("value > 0").select("user_id", "event_id", F.sum("value").over(w.orderBy("event_id")).alias("s"), F.sum("value").over(w).alias("t"))
    return rows.where(F.col("s") > 0.37 * F.col("t")).groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT doc_id, sha256(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: length(t) >= 4))), ',')) AS terms FROM documents")
def t4_long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each document's set of words of four characters or more."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws(",", F.array_sort(long_words(F.col("text")))), 256).alias("terms"))


@query("SELECT event_id, json_valid(props) AS valid, length(props)::INT AS size FROM events WHERE props IS NOT NULL")
def p27_json_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("props is not null").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"), F.char_length("props").alias("size"))
