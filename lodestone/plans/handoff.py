"""Queries of scored questions by scope, frozen hits, mapping identities and eligible levels."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import handoff
from lodestone.plans.search import BM25, GOLD, gold, lexical
from lodestone.registry import query, table

_KS = (1, 5, 20)
_PER_K = ", ".join(
    f"(coalesce(good_{k}, 0) > 0)::INT AS hit_at_{k}, coalesce(complete_rank <= {k}, false)::INT AS complete_at_{k}, CASE WHEN answerable THEN round(coalesce(recall_{k}, 0), 8) END AS recall_at_{k}, "
    f"CASE WHEN answerable THEN round(coalesce(good_{k}, 0) / nullif(coalesce(top_{k}, 0), 0), 8) END AS precision_at_{k}, CASE WHEN answerable THEN (coalesce(good_{k}, 0) = 0)::INT END AS missed_at_{k}"
    for k in _KS
)


@query(f"""WITH {BM25}, {GOLD}, hits AS (SELECT query, item, rank FROM lex WHERE rank <= 20), questions AS (SELECT item_id AS query, item_id % 5 <> 0 AS answerable FROM benchmark),
wanted AS (SELECT DISTINCT query, item % 2 AS path, item FROM gold JOIN questions USING (query) WHERE answerable),
each_path AS (SELECT query, path, min(rank) AS first, CASE WHEN count(rank) = count(*) THEN max(rank) END AS whole, {', '.join(f"count(*) FILTER (WHERE rank <= {k}) / count(*) AS r{k}" for k in _KS)} FROM wanted LEFT JOIN hits USING (query, item) GROUP BY ALL),
best AS (SELECT query, min(first)::INT AS first_rank, min(whole)::INT AS complete_rank, {', '.join(f"max(r{k}) AS recall_{k}" for k in _KS)} FROM each_path GROUP BY 1),
sources AS (SELECT query, count(DISTINCT source) AS textbooks, count(DISTINCT lang) AS providers FROM wanted JOIN documents ON doc_id = item GROUP BY 1),
good AS (SELECT query, count(*) AS returned, {', '.join(f"count(*) FILTER (WHERE rank <= {k}) AS top_{k}, count(*) FILTER (WHERE rank <= {k} AND w.item IS NOT NULL) AS good_{k}" for k in _KS)} FROM hits h LEFT JOIN (SELECT DISTINCT query, item FROM wanted) w USING (query, item) GROUP BY 1)
SELECT query AS item_id, answerable, CASE WHEN NOT answerable THEN 'unanswerable' WHEN textbooks > 1 THEN 'cross_textbook' ELSE 'single_source' END AS scope, CASE WHEN NOT answerable THEN 'unanswerable' WHEN providers > 1 THEN 'cross_provider' ELSE 'single_provider' END AS provider_scope,
first_rank, complete_rank, round(coalesce(1.0::DOUBLE / first_rank, 0), 8) AS rr, round(coalesce(1.0::DOUBLE / complete_rank, 0), 8) AS complete_rr, coalesce(returned, 0)::BIGINT AS returned, (returned IS NULL)::INT AS empty, CASE WHEN NOT answerable THEN (returned IS NOT NULL)::INT END AS false_positive, {_PER_K}
FROM questions LEFT JOIN best USING (query) LEFT JOIN sources USING (query) LEFT JOIN good USING (query)""")
def m9_scored_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question's scope, ranks, and hits, recall and precision among its first hits; every fifth stands for one without an answer."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), (F.col("item_id") % 5 != 0).alias("answerable"))
    paths = gold(spark, sf_dir).distinct().select("query", (F.col("item") % 2).alias("path"), "item")
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("textbook"), F.col("lang").alias("provider"))
    rows = handoff.scored_questions(questions, paths, lexical(spark, sf_dir, 20), items, _KS)
    rounded = {c for c in rows.columns if c.startswith(("recall", "precision")) or c.endswith("rr")}
    return rows.select(F.col("query").alias("item_id"), *[F.round(c, 8).alias(c) if c in rounded else F.col(c) for c in rows.columns[1:]])


@query(f"""WITH {BM25} SELECT query AS item_id, rank::INT AS rank, item AS doc_id, round(score, 6) AS score, sha256(d.text) AS text_hash, lang AS provider, source AS textbook, sha256('{{"corpus":"documents","mode":"lexical"}}') AS provenance FROM lex JOIN documents d ON d.doc_id = lex.item WHERE rank <= 5""")
def r17_frozen_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits frozen for the next step: of known chunks with the very text, found for the question's own words, with where they come from."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    chunks = docs.select(F.col("doc_id").alias("item"), F.col("lang").alias("provider"), F.col("source").alias("textbook"), F.sha2("text", 256).alias("text_hash"))
    questions = asked.select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    own = lexical(spark, sf_dir, 5).join(chunks.select("item", "text_hash"), "item").join(questions.withColumn("question", F.trim("question")), "query")
    found = handoff.frozen_hits(own, chunks, questions, {"mode": "lexical", "corpus": "documents"})
    return found.select(F.col("query").alias("item_id"), "rank", F.col("item").alias("doc_id"), F.round("score", 6).alias("score"), "text_hash", "provider", "textbook", "provenance")


@query("""WITH e AS (SELECT c_custkey AS k, c_name AS mapping_id, c_mktsegment AS corpus_id, c_nationkey::VARCHAR AS chunk_config_id, md5(c_name) AS source_gold_hash FROM customer), a AS (SELECT k, CASE WHEN k % 3 = 0 THEN mapping_id || '2' ELSE mapping_id END AS mapping_id, CASE WHEN k % 5 = 0 THEN NULL ELSE corpus_id END AS corpus_id, chunk_config_id, CASE WHEN k % 7 = 0 THEN 'x' ELSE source_gold_hash END AS source_gold_hash FROM e WHERE k % 11 <> 0)
SELECT e.k AS c_custkey, array_to_string(list_filter([CASE WHEN a.k IS NULL OR e.mapping_id IS DISTINCT FROM a.mapping_id THEN 'mapping_id' END, CASE WHEN a.k IS NULL OR e.corpus_id IS DISTINCT FROM a.corpus_id THEN 'corpus_id' END, CASE WHEN a.k IS NULL OR e.chunk_config_id IS DISTINCT FROM a.chunk_config_id THEN 'chunk_config_id' END, CASE WHEN a.k IS NULL OR e.source_gold_hash IS DISTINCT FROM a.source_gold_hash THEN 'source_gold_hash' END], lambda x: x IS NOT NULL), ',') AS changed FROM e LEFT JOIN a ON a.k = e.k""")
def g6_mapping_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts of each mapping's identity have changed; customers stand for mappings."""
    k = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("mapping_id"), F.col("c_mktsegment").alias("corpus_id"), F.col("c_nationkey").cast("string").alias("chunk_config_id"), F.md5(F.col("c_name").cast("binary")).alias("source_gold_hash"))
    other = own.where(k % 11 != 0).select("c_custkey", F.when(k % 3 == 0, F.concat("mapping_id", F.lit("2"))).otherwise(F.col("mapping_id")).alias("mapping_id"), F.when(k % 5 != 0, F.col("corpus_id")).alias("corpus_id"), "chunk_config_id", F.when(k % 7 == 0, "x").otherwise(F.col("source_gold_hash")).alias("source_gold_hash"))
    return handoff.changed_identity(own, other, "c_custkey").select("c_custkey", F.array_join("changed", ",").alias("changed"))


@query("""WITH e AS (SELECT o_orderkey, ['full', 'endpoint_only', 'excluded', NULL][(o_orderkey % 4 + 1)::INT] AS eligibility FROM orders), l AS (SELECT unnest(['beginner', 'intermediate', 'advanced']) AS level)
SELECT level, count(*)::BIGINT AS cells FROM e, l WHERE eligibility IN ('full', 'endpoint_only') GROUP BY 1""")
def p36_eligible_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each level that count, by the eligibility of orders that stand for questions."""
    classes = F.array(F.lit("full"), F.lit("endpoint_only"), F.lit("excluded"), F.lit(None).cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.explode(handoff.eligible_levels(F.element_at(classes, (F.col("o_orderkey") % 4 + 1).cast("int")))).alias("level"))
    return rows.groupBy("level").agg(F.count("*").alias("cells"))
