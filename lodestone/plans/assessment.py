"""Queries of readability, runs and places in texts, overrides, rules of splitting and noise."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import readability
from lodestone.operators import joins, stats
from lodestone.operators.spans import contiguous, line_spans
from lodestone.plans.corpus import LINES
from lodestone.registry import query, table

SPANS = f"{LINES}, o AS (SELECT doc_id, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, length(line) AS n FROM lines)"


@query(r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?|[0-9]+(?:\.[0-9]+)?') AS words, greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda p: regexp_matches(p, '\S')))) AS sentences FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, list_transform(list_filter(words, lambda x: regexp_matches(x, '^[A-Za-z]')), lambda x: {'w': lower(x), 'n': len(regexp_extract_all(lower(x), '[aeiouy]+'))}) AS spelled FROM w),
c AS (SELECT doc_id, text, len(words) AS n, sentences, coalesce(list_sum(list_transform(spelled, lambda s: greatest(1, s.n - (s.n > 1 AND s.w[-1] = 'e')::INT))), 0) AS syllables, len(list_filter(words, lambda x: lower(x) IN ('force', 'energy', 'the'))) AS jargon FROM g)
SELECT doc_id, n::BIGINT AS n_words, length(text)::BIGINT AS n_characters, sentences::BIGINT AS n_sentences, syllables::BIGINT AS n_syllables, round(CASE WHEN n > 0 THEN 0.39::DOUBLE * (n / sentences) + 11.8::DOUBLE * (syllables / n) - 15.59 END, 6) AS grade, round(jargon / nullif(n, 0), 8) AS jargon_ratio,
regexp_matches(text, '[=≈≠≤≥±×÷]|\b(?:sin|cos|tan|log|sqrt)\s*\(|\^[0-9]') AS formula FROM c""")
def p26_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", readability(F.col("text"), ("force", "energy", "the")).alias("r"))
    count = lambda c: F.col(f"r.{c}").cast("long").alias(f"n_{c}")
    return rows.select("doc_id", *map(count, ("words", "characters", "sentences", "syllables")), F.round("r.grade", 6).alias("grade"), F.round(F.try_divide("r.jargon", "r.words"), 8).alias("jargon_ratio"), F.col("r.formula").alias("formula"))


@query(f"""WITH {SPANS}, t AS (SELECT *, CASE WHEN s - lag(s + n) OVER (PARTITION BY doc_id ORDER BY s) IN (0, 2) THEN 0 ELSE 1 END AS new FROM o WHERE n > 0),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM t), u AS (SELECT doc_id, run, max(s + n) - min(s) AS size FROM r GROUP BY ALL)
SELECT doc_id, count(*)::BIGINT AS runs, max(size)::BIGINT AS longest FROM u GROUP BY 1""")
def c15_contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines that touch or stand two characters apart, as those around a blank line do; neighbouring lines are one apart."""
    runs = contiguous(line_spans(table(spark, sf_dir, "documents")).drop("line").where("end > start"), "doc")
    return runs.groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("runs"), F.max(F.col("end") - F.col("start")).alias("longest"))


@query(f"""WITH {SPANS}, p AS (SELECT doc_id, unnest(range(0, length(text), 500)) AS place FROM documents WHERE length(text) > 0)
SELECT doc_id, place::BIGINT AS place, line_no::INT AS line_no FROM p JOIN o USING (doc_id) WHERE place >= s AND place < s + n""")
def j6_lines_of_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that holds every 500th character."""
    docs = table(spark, sf_dir, "documents")
    every = F.explode(F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(500)))
    places = docs.where(F.char_length("text") > 0).select(F.col("doc_id").alias("doc"), every.alias("other_start")).withColumn("other_end", F.col("other_start") + 1)
    met = joins.overlapping(line_spans(docs).drop("line"), places, ["doc"], 256)
    return met.select(F.col("doc").alias("doc_id"), F.col("other_start").cast("long").alias("place"), "line_no")


@query("""SELECT l.lang, q.quality, count(d.doc_id)::BIGINT AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (VALUES (0), (1)) q(quality)
LEFT JOIN (SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)) d ON d.lang = l.lang AND d.quality = q.quality GROUP BY ALL""")
def m36_dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of each language and quality, with cells of none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    counts = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))
    grid = docs.select("lang").distinct().withColumn("quality", F.explode(F.array(F.lit(0), F.lit(1))))
    return grid.join(counts, ["lang", "quality"], "left").select("lang", "quality", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH t AS (SELECT l_suppkey, sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2))) AS spent FROM lineitem GROUP BY 1)
SELECT l_suppkey, spent::VARCHAR AS spent, CASE WHEN spent >= 1500000 THEN 'stop' WHEN spent >= 1200000 THEN 'warn' ELSE 'go' END AS action FROM t""")
def m38_spend_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier's lines cost, in decimals throughout, and the action that the sum asks for."""
    money = F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
    spent = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(money).cast("decimal(38,4)").alias("spent"))
    action = F.when(F.col("spent") >= 1500000, "stop").when(F.col("spent") >= 1200000, "warn").otherwise("go")
    return spent.select("l_suppkey", F.col("spent").cast("string").alias("spent"), action.alias("action"))


@query("""WITH r AS (SELECT doc_id, count(*) AS n, any_value(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1)
SELECT doc_id, CASE WHEN n > 1 THEN NULL ELSE coalesce('rated-' || r.quality, source) END AS source, CASE WHEN n IS NULL THEN 'kept' WHEN n = 1 THEN 'overridden' ELSE 'refused' END AS outcome FROM documents LEFT JOIN r USING (doc_id)""")
def m33_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents, replaced where a review of the key exists; two reviews of one key are refused."""
    reviews = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.any_value("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(reviews, "doc_id", "left")
    outcome = F.when(F.col("n").isNull(), "kept").when(F.col("n") == 1, "overridden").otherwise("refused")
    return docs.select("doc_id", F.when(outcome != "refused", F.coalesce(F.concat(F.lit("rated-"), F.col("quality").cast("string")), "source")).alias("source"), outcome.alias("outcome"))


@query("SELECT l_orderkey, CASE WHEN bool_and(l_partkey % 20 <= 16) THEN 'dev' WHEN bool_and(l_partkey % 20 > 16) THEN 'test' ELSE 'mixed' END AS split FROM lineitem GROUP BY 1")
def o5_split_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's split by the chapters of all its evidence."""
    low = F.col("l_partkey") % 20 <= 16
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(F.bool_and(low), "dev").when(F.bool_and(~low), "test").otherwise("mixed").alias("split"))


@query("""WITH o AS (SELECT o_custkey, o_orderpriority AS arm, o_orderkey, (o_totalprice > 150000)::INT AS good, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM orders),
p AS (SELECT a.arm, a.good AS first, b.good AS second FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.run % 2 = 1 AND b.run = a.run + 1)
SELECT arm, count(*)::BIGINT AS pairs, count(*) FILTER (WHERE first <> second)::BIGINT AS flips, round(avg((first <> second)::INT), 8) AS flip_rate, round(sqrt(avg((first <> second)::INT) / count(*)), 8) AS floor,
round(avg(second - first), 8) AS shift, round(sqrt(avg((second - first) ** 2) / count(*)), 8) AS spread FROM p GROUP BY 1""")
def q23_flip_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's neighbouring orders as repeats of one run: how often the verdict flips, and the noise that this alone makes."""
    run = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    good = (F.col("o_totalprice") > 150000).cast("int")
    runs = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("arm"), good.alias("first"), run.alias("run"))
    second = F.lead("first").over(Window.partitionBy("o_custkey").orderBy("run"))
    pairs = runs.withColumn("second", second).where("run % 2 = 1 and second is not null")
    flip, moved = (F.col("first") != F.col("second")).cast("int"), F.col("second") - F.col("first")
    n = F.count("*")
    return pairs.groupBy("arm").agg(n.alias("pairs"), F.sum(flip).alias("flips"), F.round(F.avg(flip), 8).alias("flip_rate"), F.round(F.sqrt(F.avg(flip) / n), 8).alias("floor"), F.round(F.avg(moved), 8).alias("shift"), F.round(F.sqrt(F.avg(moved * moved) / n), 8).alias("spread"))


@query("""SELECT lang, count(*)::BIGINT AS n, round(CASE WHEN count(*) >= 3 AND var_pop(n_chars) > 0 AND var_pop(quality) > 0 THEN covar_pop(n_chars, quality) / sqrt(var_pop(n_chars) * var_pop(quality)) END, 8) AS r
FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL GROUP BY 1""")
def q14_surface_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a quality label goes with mere length, by language."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.correlation(rows, ["lang"], "n_chars", "quality").select("lang", "n", F.round("r", 8).alias("r"))
