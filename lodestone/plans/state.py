"""Queries of event logs: streams of versions, per-topic state, revocations, reports, votes.

Events stand for a learner's log: user and event type for profile and topic, the value for how good an answer was. An id
divisible by 97 makes an event an override, by 31 a revocation, by 11 (or a missing value) a skip.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.search import BM25, lexical
from lodestone.registry import query, table
from lodestone.streaming.learner import replayed, states

TOPIC = ["user_id", "event_type"]
LOG = """e AS (SELECT user_id, event_type, event_id, ts, CASE WHEN event_id % 97 = 0 THEN 'override' WHEN event_id % 31 = 0 THEN 'revoke' WHEN value IS NULL OR event_id % 11 = 0 THEN 'skip' ELSE 'submit' END AS kind,
  (value >= 20)::INT AS good, (event_id % 3)::INT AS difficulty, (event_id % 3)::INT AS level, (user_id % 3)::INT AS start FROM events)"""
DEPTHS = """s AS (SELECT *, row_number() OVER w AS place, sum(CASE kind WHEN 'submit' THEN 1 WHEN 'revoke' THEN -1 ELSE 0 END) OVER w AS s FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
h AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id, event_type ORDER BY place ROWS UNBOUNDED PRECEDING)) AS depth FROM s),
d AS (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY user_id, event_type ORDER BY place) AS before FROM h)"""
SURVIVING = f"""{DEPTHS}, kept AS (SELECT * FROM (SELECT *, kind = 'submit' AND coalesce(min(depth) OVER (PARTITION BY user_id, event_type ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), depth) < depth AS gone FROM d) WHERE NOT gone)"""


def _fold(source: str, kinds: str) -> str:
    """SQL of the states after all events of some kinds of source, step by step."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM {source} WHERE kind IN ({kinds})),
f AS (SELECT DISTINCT user_id, event_type, 0::BIGINT AS i, start AS level, 0.5::DOUBLE AS score, 0 AS since, ''::VARCHAR AS recent, 0 AS attempts, 0 AS right_ones, 0 AS move FROM o
UNION ALL SELECT user_id, event_type, i, level + move, CASE WHEN move <> 0 THEN 0.5 ELSE score END, CASE WHEN move <> 0 THEN 0 ELSE since END, CASE WHEN move <> 0 THEN '' ELSE recent END, attempts, right_ones, move FROM (
 SELECT *, CASE WHEN kind <> 'submit' OR length(recent) < 6 THEN 0
   WHEN level < 2 AND score >= 0.75 THEN (len(list_filter([substr(recent, 1, 2), substr(recent, 3, 2), substr(recent, 5, 2)], lambda x: x[1] = '1' AND x[2]::INT > level)) >= 2)::INT
   WHEN level > 0 AND score <= 0.25 THEN -((len(list_filter([substr(recent, 1, 2), substr(recent, 3, 2), substr(recent, 5, 2)], lambda x: x[1] = '0' AND x[2]::INT <= level)) >= 2)::INT) ELSE 0 END AS move FROM (
  SELECT f.user_id, f.event_type, o.i, o.kind, CASE kind WHEN 'override' THEN o.level ELSE f.level END AS level,
   CASE kind WHEN 'override' THEN 0.5 WHEN 'submit' THEN f.score + 0.2 * (CASE WHEN (o.good = 1 AND o.difficulty < f.level) OR (o.good = 0 AND o.difficulty > f.level) THEN 0.5::DOUBLE ELSE 1 END) * (o.good - f.score) ELSE f.score END AS score,
   CASE kind WHEN 'override' THEN 0 WHEN 'submit' THEN f.since + 1 ELSE f.since END AS since, CASE kind WHEN 'override' THEN '' WHEN 'submit' THEN right(f.recent || o.good || o.difficulty, 6) ELSE f.recent END AS recent,
   f.attempts + (kind = 'submit')::INT AS attempts, f.right_ones + (kind = 'submit' AND o.good = 1)::INT AS right_ones FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.i = f.i + 1)))"""


LAST_STATE = """SELECT user_id, event_type, attempts::INT AS attempts, right_ones::INT AS right_ones, round(score, 8) AS score, level::INT AS level, since::INT AS since, least(1.0, since / 5.0)::DOUBLE AS coverage
FROM f QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY i DESC) = 1"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda n: F.col("event_id") % n == 0
    kind = F.when(at(97), "override").when(at(31), "revoke").when(F.col("value").isNull() | at(11), "skip").otherwise("submit")
    third = (F.col("event_id") % 3).cast("int")
    good = (F.col("value") >= 20).cast("int")
    return table(spark, sf_dir, "events").select(*TOPIC, "event_id", "ts", kind.alias("kind"), good.alias("good"), third.alias("difficulty"), third.alias("level"), (F.col("user_id") % 3).cast("int").alias("start"))


@query(f"WITH RECURSIVE {LOG}, {_fold('e', repr('submit') + ',' + repr('override'))} {LAST_STATE}")
def w1_learner_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after all answers and overrides, revocations left aside."""
    return states(log(spark, sf_dir).where("kind in ('submit', 'override')"), TOPIC, ["ts", "event_id"])


@query(f"WITH RECURSIVE {LOG}, {SURVIVING}, {_fold('kept', repr('submit') + ',' + repr('override') + ',' + repr('revoke') + ',' + repr('skip'))} {LAST_STATE}")
def w3_revoked_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after all events, as if revoked answers had never been given."""
    return states(log(spark, sf_dir), TOPIC, ["ts", "event_id"])


@query(f"WITH RECURSIVE {LOG}, {_fold('e', repr('submit') + ',' + repr('override'))} SELECT event_type, count(*) FILTER (WHERE move > 0)::BIGINT AS promotions, count(*) FILTER (WHERE move < 0)::BIGINT AS demotions FROM f WHERE i > 0 GROUP BY 1")
def w4_level_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that answers moved up and down, by topic; overrides move none."""
    rows = replayed(log(spark, sf_dir).where("kind in ('submit', 'override')"), TOPIC, ["ts", "event_id"])
    return rows.groupBy("event_type").agg(F.count_if(F.col("move") > 0).alias("promotions"), F.count_if(F.col("move") < 0).alias("demotions"))


def depths(events: DataFrame) -> DataFrame:
    """events with place, and depth: the answers of the topic that still count after each. before is the depth ahead of it."""
    by = Window.partitionBy(*TOPIC).orderBy("ts", "event_id")
    step = F.when(F.col("kind") == "submit", 1).when(F.col("kind") == "revoke", -1).otherwise(0)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("place", F.row_number().over(by)).withColumn("sum", F.sum(step).over(upto))
    rows = rows.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto)))
    return rows.withColumn("before", F.lag("depth", 1, 0).over(by)).drop("sum")


@query(f"""WITH {LOG}, {DEPTHS}, g AS (SELECT user_id, count(*) FILTER (WHERE kind = 'revoke')::BIGINT AS revocations, count(*) FILTER (WHERE kind = 'revoke' AND before = 0)::BIGINT AS without_answer, count(*) - count(DISTINCT event_id) AS repeated_ids FROM d GROUP BY 1),
v AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events), b AS (SELECT user_id, count(*) FILTER (WHERE ts < last)::BIGINT AS backwards FROM v GROUP BY 1)
SELECT user_id, revocations, without_answer, repeated_ids::BIGINT AS repeated_ids, backwards FROM g JOIN b USING (user_id)""")
def w2_stream_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strict replay of each user's log refuses: revocations of nothing, repeated ids, and ids against the order of time."""
    rows = depths(log(spark, sf_dir)).groupBy("user_id")
    revoke = F.col("kind") == "revoke"
    found = rows.agg(F.count_if(revoke).alias("revocations"), F.count_if(revoke & (F.col("before") == 0)).alias("without_answer"), (F.count("*") - F.countDistinct("event_id")).alias("repeated_ids"))
    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    order = table(spark, sf_dir, "events").withColumn("last", last).groupBy("user_id").agg(F.count_if(F.col("ts") < F.col("last")).alias("backwards"))
    return found.join(order, "user_id")


@query("""WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS expected, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS last FROM conversations)
SELECT conv_id, count(*)::BIGINT AS turns, count(*) FILTER (WHERE turn <> expected)::BIGINT AS gaps, (count(*) - count(DISTINCT turn))::BIGINT AS repeated, count(*) FILTER (WHERE role = last)::BIGINT AS same_role FROM n GROUP BY 1""")
def w2_version_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams whose turns are versions: turns that aren't where they belong, and turns that come twice."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, sf_dir, "conversations").withColumn("expected", F.row_number().over(by) - 1).withColumn("last", F.lag("role").over(by))
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("turn") != F.col("expected")).alias("gaps"), (F.count("*") - F.countDistinct("turn")).alias("repeated"), F.count_if(F.col("role") == F.col("last")).alias("same_role"))


M34_SQL = """count(*) FILTER (WHERE kind = 'submit')::BIGINT AS submitted, count(*) FILTER (WHERE kind = 'submit' AND good = 1)::BIGINT AS right_ones, count(*) FILTER (WHERE kind = 'skip')::BIGINT AS skipped, count(*) FILTER (WHERE kind = 'revoke')::BIGINT AS revoked,
round(count(*) FILTER (WHERE kind = 'submit' AND good = 1) / nullif(count(*) FILTER (WHERE kind = 'submit'), 0), 8) AS accuracy, round(count(*) FILTER (WHERE kind = 'skip') / nullif(count(*) FILTER (WHERE kind IN ('submit', 'skip')), 0), 8) AS skip_rate,
round(count(*) FILTER (WHERE kind = 'revoke') / nullif(count(*) FILTER (WHERE kind = 'submit'), 0), 8) AS revocation_rate"""


@query(f"""WITH {LOG}, {DEPTHS}, l AS (SELECT *, lag(difficulty) OVER (PARTITION BY user_id, event_type, CASE kind WHEN 'submit' THEN depth WHEN 'revoke' THEN before END, kind IN ('submit', 'revoke') ORDER BY place) AS target FROM d),
t AS (SELECT event_type, CASE WHEN kind = 'revoke' AND before > 0 THEN target WHEN kind IN ('submit', 'skip') THEN difficulty END AS difficulty, kind, good FROM l)
SELECT event_type, difficulty, grouping(event_type)::INT AS all_topics, grouping(difficulty)::INT AS all_difficulties, {M34_SQL} FROM t GROUP BY GROUPING SETS ((event_type), (difficulty), (event_type, difficulty), ()) HAVING difficulty IS NOT NULL OR grouping(difficulty) = 1""")
def m34_event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, skips and revocations by topic, difficulty, both and in all. A revocation counts where its answer does.

    The answer that a revocation takes back is the last one that raised the number of counting answers to what it was.
    """
    rows = depths(log(spark, sf_dir))
    answer_or_revoke = F.col("kind").isin("submit", "revoke")
    height = F.when(F.col("kind") == "submit", F.col("depth")).when(F.col("kind") == "revoke", F.col("before"))
    rows = rows.withColumn("height", height).withColumn("paired", answer_or_revoke)
    target = F.lag("difficulty").over(Window.partitionBy(*TOPIC, "height", "paired").orderBy("place"))
    own = F.when((F.col("kind") == "revoke") & (F.col("before") > 0), F.col("target")).when(F.col("kind").isin("submit", "skip"), F.col("difficulty"))
    told = rows.withColumn("target", target).select("event_type", own.alias("difficulty"), "kind", "good")
    submitted, right = F.count_if(F.col("kind") == "submit"), F.count_if((F.col("kind") == "submit") & (F.col("good") == 1))
    skipped, revoked = F.count_if(F.col("kind") == "skip"), F.count_if(F.col("kind") == "revoke")
    sets = told.groupingSets([["event_type"], ["difficulty"], ["event_type", "difficulty"], []], "event_type", "difficulty")
    out = sets.agg(
        F.grouping("event_type").cast("int").alias("all_topics"), F.grouping("difficulty").cast("int").alias("all_difficulties"),
        submitted.alias("submitted"), right.alias("right_ones"), skipped.alias("skipped"), revoked.alias("revoked"),
        F.round(F.try_divide(right, submitted), 8).alias("accuracy"), F.round(F.try_divide(skipped, submitted + skipped), 8).alias("skip_rate"), F.round(F.try_divide(revoked, submitted), 8).alias("revocation_rate"),
    )
    return out.where("difficulty is not null or all_difficulties = 1")


VOTE = """v AS (SELECT query, topic, sum(1.0::DOUBLE / (rank * 2)) AS votes FROM t GROUP BY ALL), s AS (SELECT *, round(votes / sum(votes) OVER (PARTITION BY query), 8) AS support FROM v),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY support DESC, topic) AS place, count(*) OVER (PARTITION BY query, support) AS ties FROM s)
SELECT q.item_id, CASE WHEN ties = 1 AND support >= {least} THEN topic END AS topic, round(support, 6) AS support, CASE WHEN topic IS NULL THEN '{none}' WHEN ties > 1 THEN 'TOPIC_TIE' WHEN support < {least} THEN 'TOPIC_SUPPORT_BELOW_THRESHOLD' ELSE 'RESOLVED' END AS status
FROM benchmark q LEFT JOIN (SELECT * FROM p WHERE place = 1) p ON p.query = q.item_id"""


def voted(questions: DataFrame, hits: DataFrame, topics: DataFrame, least: float, none: str) -> DataFrame:
    """(query, topic, support, status): hits (query, item, rank) vote for topics (item, topic), split evenly over an item's topics.

    Shares are of all votes. A tie, or less than least, gives no topic; none is the status of a question without votes.
    """
    many = topics.groupBy("item").agg(F.count("*").alias("many"))
    votes = hits.join(topics.join(many, "item"), "item").groupBy("query", "topic").agg(F.sum(1.0 / (F.col("rank") * F.col("many"))).alias("votes"))
    shares = votes.withColumn("support", F.round(F.col("votes") / F.sum("votes").over(Window.partitionBy("query")), 8))
    placed = shares.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("support"), "topic"))).withColumn("ties", F.count("*").over(Window.partitionBy("query", "support")))
    out = questions.join(placed.where("place = 1"), "query", "left")
    status = F.when(F.col("topic").isNull(), none).when(F.col("ties") > 1, "TOPIC_TIE").when(F.col("support") < least, "TOPIC_SUPPORT_BELOW_THRESHOLD").otherwise("RESOLVED")
    return out.select("query", F.when(status == "RESOLVED", F.col("topic")).alias("topic"), "support", status.alias("status"))


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pairs = F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")))
    return docs.select(F.col("doc_id").alias("item"), pairs.alias("topic")).where("topic is not null")


TOPICS = "t AS (SELECT query, rank, unnest(['lang:' || lang, 'source:' || source]) AS topic FROM {hits} JOIN documents ON item = doc_id)"


@query(f"WITH {BM25}, hits AS (SELECT * FROM lex WHERE rank <= 10), {TOPICS.format(hits='hits')}, {VOTE.format(least=0.3, none='NO_RETRIEVAL_HITS')}")
def w6_topic_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's topic by its ten best hits, whose language and source are their topics."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"))
    out = voted(questions, lexical(spark, sf_dir, 10), _topics(spark, sf_dir), 0.3, "NO_RETRIEVAL_HITS")
    return out.select(F.col("query").alias("item_id"), "topic", F.round("support", 6).alias("support"), "status")


@query(f"WITH {BM25}, hits AS (SELECT * FROM lex WHERE rank <= 10 AND item % 2 = 0), {TOPICS.format(hits='hits')}, {VOTE.format(least=0.3, none='NO_CITATIONS')}")
def w7_cited_topic_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vote by cited hits alone, with their ranks among all; documents of even ids stand for what an answer cites."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"))
    cited = _topics(spark, sf_dir).select("item").distinct().where("item % 2 = 0")
    out = voted(questions, lexical(spark, sf_dir, 10).join(cited, "item", "left_semi"), _topics(spark, sf_dir), 0.3, "NO_CITATIONS")
    return out.select(F.col("query").alias("item_id"), "topic", F.round("support", 6).alias("support"), "status")


@query(f"WITH RECURSIVE {LOG}, {SURVIVING}, {_fold('kept', repr('submit') + ',' + repr('override') + ',' + repr('revoke') + ',' + repr('skip'))}, w AS ({LAST_STATE}), u AS (SELECT user_id, min(user_id % 3)::INT AS start FROM events GROUP BY 1), t AS (SELECT DISTINCT event_type FROM events)"
       " SELECT u.user_id, t.event_type, coalesce(w.level, u.start)::INT AS level, coalesce(w.score, 0.5) AS score, coalesce(w.coverage, 0) AS coverage, w.level IS NOT NULL AS seen FROM u CROSS JOIN t LEFT JOIN w ON w.user_id = u.user_id AND w.event_type = t.event_type")
def w9_learner_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's level in every topic: the replayed one, or else the level the user starts from."""
    events = table(spark, sf_dir, "events")
    grid = events.select("user_id", (F.col("user_id") % 3).cast("int").alias("start")).distinct().crossJoin(F.broadcast(events.select("event_type").distinct()))
    rows = grid.join(states(log(spark, sf_dir), TOPIC, ["ts", "event_id"]), TOPIC, "left")
    return rows.select(*TOPIC, F.coalesce("level", "start").alias("level"), F.coalesce("score", F.lit(0.5)).alias("score"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.col("level").isNotNull().alias("seen"))


@query("""WITH t AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT before, event_type, count(*)::BIGINT AS n FROM t WHERE before IS NOT NULL GROUP BY ALL""")
def event_successions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which type of event follows which in users' logs."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("before", before).where("before is not null").groupBy("before", "event_type").agg(F.count("*").alias("n"))
