"""Queries of validated joins, of the event store and of a batch run that is stopped and resumed."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import joins, splits
from lodestone.registry import query, table
from lodestone.sources import runs
from lodestone.sources.events import EventStore
from lodestone.sources.shared import scratch

_SCORE = "CASE WHEN sum(l_quantity) FILTER (WHERE {c}) < 40 THEN 0 WHEN sum(l_quantity) FILTER (WHERE {c}) < 90 THEN 1 WHEN sum(l_quantity) FILTER (WHERE {c}) >= 90 THEN 2 END"


def _runs(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """Orders as runs: the score of the lines with odd or even numbers, and what doesn't depend on those."""
    lines = table(spark, sf_dir, "lineitem")
    q = F.sum(F.when(F.col("l_linenumber") % 2 == odd, F.col("l_quantity")))
    score = F.when(q < 40, 0).when(q < 90, 1).when(q >= 90, 2)
    return lines.groupBy(F.col("l_orderkey").alias("run_id")).agg(score.alias("score"), F.min("l_partkey").alias("question_id"), F.min("l_returnflag").alias("target_level"), F.max("l_linestatus").alias("condition"))


@query(f"""WITH r AS (SELECT l_orderkey AS run_id, {_SCORE.format(c="l_linenumber % 2 = 1")} AS first, {_SCORE.format(c="l_linenumber % 2 = 0")} AS second, min(l_partkey) AS question_id, min(l_returnflag) AS target_level, max(l_linestatus) AS condition FROM lineitem GROUP BY 1),
s AS (SELECT *, CASE WHEN condition = 'F' AND question_id % 5 = 0 THEN 'not_applicable' WHEN first IS NULL OR second IS NULL THEN 'not_evaluated' ELSE 'evaluated' END AS state FROM r WHERE run_id % 4 = 0)
SELECT run_id, question_id, target_level, condition, first, second, state, CASE WHEN state = 'evaluated' THEN second - first END AS difference, CASE WHEN state = 'evaluated' THEN (second = 2) <> (first = 2) END AS flip FROM s""")
def j10_paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs beside their baselines, whose question, level and condition must be the same: states, differences and flips of scores."""
    same = ["question_id", "target_level", "condition"]
    baseline, repeat = _runs(spark, sf_dir, 1), _runs(spark, sf_dir, 0).where("run_id % 4 = 0")
    pairs = joins.paired(baseline, repeat, ["run_id"], same)
    applicable = ~((F.col("repeat.condition") == "F") & (F.col("repeat.question_id") % 5 == 0))
    return joins.paired_differences(pairs, "score", 2, applicable).select("run_id", *[f"repeat.{c}" for c in same], "first", "second", "state", "difference", "flip")


_PAIR_SUMS = "count(*)::BIGINT AS pairs, count(*) FILTER (WHERE state = 'evaluated')::BIGINT AS evaluated, count(*) FILTER (WHERE state = 'not_evaluated')::BIGINT AS not_evaluated, count(*) FILTER (WHERE flip)::BIGINT AS flips"


@query(f"""WITH r AS (SELECT l_orderkey AS run_id, {_SCORE.format(c="l_linenumber % 2 = 1")} AS first, {_SCORE.format(c="l_linenumber % 2 = 0")} AS second, min(l_returnflag) AS target_level, max(l_linestatus) AS condition FROM lineitem GROUP BY 1),
s AS (SELECT *, CASE WHEN first IS NULL OR second IS NULL THEN 'not_evaluated' ELSE 'evaluated' END AS state FROM r WHERE run_id % 4 = 0), f AS (SELECT *, state = 'evaluated' AND (second = 2) <> (first = 2) AS flip FROM s),
g AS (SELECT condition, target_level, {_PAIR_SUMS} FROM f GROUP BY ALL)
SELECT condition, target_level, pairs, evaluated, not_evaluated, flips, round(flips / pairs, 8) AS low, round((flips + not_evaluated) / pairs, 8) AS high, CASE WHEN not_evaluated = 0 THEN round(sqrt(flips / pairs / pairs), 8) END AS floor FROM g""")
def j10_q23_repeat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flips of repeated runs by condition and level, with bounds for what isn't scored and the noise floor where all is."""
    pairs = joins.paired(_runs(spark, sf_dir, 1), _runs(spark, sf_dir, 0).where("run_id % 4 = 0"), ["run_id"], ["question_id", "target_level", "condition"])
    rows = joins.paired_differences(pairs, "score", 2)
    is_ = lambda s: F.count_if(F.col("state") == s)
    by = rows.groupBy("repeat.condition", "repeat.target_level").agg(F.count("*").alias("pairs"), is_("evaluated").alias("evaluated"), is_("not_evaluated").alias("not_evaluated"), F.count_if("flip").alias("flips"))
    n, flips, open_ = F.col("pairs"), F.col("flips"), F.col("not_evaluated")
    return by.select("*", F.round(flips / n, 8).alias("low"), F.round((flips + open_) / n, 8).alias("high"), F.when(open_ == 0, F.round(F.sqrt(flips / n / n), 8)).alias("floor"))


@query("""WITH s AS (SELECT l_partkey, l_returnflag AS f, count(*)::BIGINT AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)
SELECT a.l_partkey, a.lines AS lines_a, r.lines AS lines_r, a.quantity AS quantity_a, r.quantity AS quantity_r, (coalesce(a.lines, 0) + coalesce(r.lines, 0))::BIGINT AS lines FROM (SELECT * FROM s WHERE f = 'A') a JOIN (SELECT * FROM s WHERE f = 'R') r ON a.l_partkey = r.l_partkey""")
def j14_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two summaries of parts merged one to one."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    side = lambda f: sums.where(F.col("l_returnflag") == f).drop("l_returnflag")
    merged = joins.one_to_one(side("A"), side("R"), ["l_partkey"], suffixes=("_a", "_r"))
    return merged.withColumn("lines", F.col("lines_a") + F.col("lines_r"))


@query("""WITH b AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 <> 0 THEN 1 WHEN event_id % 2 = 0 THEN 2 ELSE 3 END AS batch FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY batch, ts, event_id) AS stream_version, row_number() OVER (PARTITION BY user_id ORDER BY batch, ts, event_id) - 1 AS state_version_before FROM b""")
def w5_event_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a store in three batches that overlap: each once, with its version in its user's stream."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").alias("created_at"))
    store = EventStore(spark, scratch(spark, "events"), events.schema, stream=["user_id"])
    for batch in ("event_id % 3 <> 0", "event_id % 2 = 0", "true"):
        store.append(events.where(batch), "created_at")
    return store.read().select("user_id", "event_id", "stream_version", "state_version_before")


@query("SELECT item_id, length(text) AS n_chars, sha256(text) AS text_hash FROM benchmark")
def w11_resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a batch run over the benchmark that is stopped after two portions and then resumed to its end."""
    questions, path, calls = table(spark, sf_dir, "benchmark"), scratch(spark, "run"), []

    def work(rows: DataFrame) -> DataFrame:
        return rows.select("item_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))

    def stopped(rows: DataFrame) -> DataFrame:
        calls.append(1)
        if len(calls) > 2:
            raise InterruptedError("stopped here")
        return work(rows)

    manifest = {"run": "text hashes", "version": 1}
    try:
        runs.run_batch(questions, manifest, stopped, path, key="item_id", portions=4)
    except Exception as e:
        if "stopped here" not in str(e):
            raise
    return runs.run_batch(questions, manifest, work, path, key="item_id", portions=4, resume=True)


@query("""WITH r AS (SELECT o_orderkey, o_custkey AS component, c_mktsegment AS source, o_orderpriority AS stratum FROM orders JOIN customer ON c_custkey = o_custkey),
e AS (SELECT component, stratum, source, count(*) AS n FROM r GROUP BY ALL), c AS (SELECT component, min(source) AS source, sum(n)::BIGINT AS size, (min({'m': -n, 's': stratum})).s AS stratum, md5('split|' || component) AS draw FROM e GROUP BY 1),
t AS (SELECT source, sum(size) AS total, sum(size)::BIGINT // 5 AS quota FROM c GROUP BY 1), h AS (SELECT source, stratum, sum(size) AS own FROM c GROUP BY ALL),
a AS (SELECT c.*, quota, sum(size) OVER (PARTITION BY c.source, c.stratum ORDER BY draw, component ROWS UNBOUNDED PRECEDING) <= floor(quota * own / total) AS taken FROM c JOIN t ON t.source = c.source JOIN h ON h.source = c.source AND h.stratum = c.stratum),
l AS (SELECT source, max(quota) - coalesce(sum(size) FILTER (WHERE taken), 0) AS room FROM a GROUP BY 1),
f AS (SELECT a.*, sum(size) OVER (PARTITION BY a.source ORDER BY size, draw, component ROWS UNBOUNDED PRECEDING) <= room AS more FROM a JOIN l ON l.source = a.source WHERE NOT taken)
SELECT component, source, stratum, size, true AS chosen FROM a WHERE taken UNION ALL SELECT component, source, stratum, size, more FROM f""")
def o4_balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders are a fifth of their segment's, balanced by priority: whole customers, and the quota met within one of them."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("component"), F.col("c_mktsegment").alias("source"), F.col("o_orderpriority").alias("stratum"))
    found = splits.components_of(rows, "component", "source", "stratum")
    quotas = found.groupBy("source").agg(F.floor(F.sum("size") / 5).alias("quota"))
    return splits.balanced_split(found, quotas).select("component", "source", "stratum", "size", "chosen")
