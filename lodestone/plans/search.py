"""Queries of the search family: the benchmark's texts ask, the documents answer."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import STOP_WORDS, query_terms, search_terms
from lodestone.operators import metrics
from lodestone.operators.lexicon import Lexicon
from lodestone.operators.search import fused, top
from lodestone.registry import query, table

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
TERMS = "regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-z0-9]+')"
INDEX = f"""
asked0 AS (SELECT item_id AS query, unnest({TERMS}) AS term FROM benchmark),
asked AS (SELECT query, term, count(*) AS qtf FROM asked0 WHERE term NOT IN ({STOPS}) GROUP BY ALL),
listed AS (SELECT doc_id AS item, {TERMS} AS terms FROM documents),
flat AS (SELECT item, len(terms) AS length, unnest(terms) AS term FROM listed),
post AS (SELECT item, length, term, count(*) AS tf FROM flat GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sizes AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM listed)
"""
BM25 = f"""{INDEX},
bm AS (SELECT query, item, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 8) AS score
       FROM post JOIN df USING (term) JOIN asked USING (term), sizes GROUP BY query, item),
lex AS (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM bm WHERE score > 0)
"""
COVER = f"""
one AS (SELECT DISTINCT query, term FROM asked),
idfs AS (SELECT query, term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM one LEFT JOIN df USING (term), sizes),
whole AS (SELECT query, sum(idf) AS whole, count(*) AS terms FROM idfs GROUP BY query),
met AS (SELECT query, item, sum(idf) AS covered, count(*) AS overlap FROM idfs JOIN post USING (term) GROUP BY query, item),
cov AS (SELECT query, item, overlap, round(covered / whole, 4) AS score FROM met JOIN whole USING (query)
        WHERE round(covered / whole, 4) >= 0.2 AND overlap >= least(2, terms)),
cover AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, overlap DESC, item) AS rank FROM cov)
"""
GOLD = "gold AS (SELECT item_id AS query, doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def lexicon(spark: SparkSession, sf_dir: str) -> Lexicon:
    return Lexicon(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", query_terms(F.col("text")), search_terms(F.col("text")))


def lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexicon(spark, sf_dir).bm25(k)


def covering(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexicon(spark, sf_dir).coverage(k)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text. A text's longest inner term stands in them as a term, which gives the pairs to look at; texts of under 3 terms are looked for in every document."""
    items, docs = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")), table(spark, sf_dir, "documents").select("doc_id", "text")
    terms = search_terms(F.col("passage"))
    inner = F.slice(terms, 2, F.greatest(F.size(terms) - 2, F.lit(0)))
    probe = items.withColumn("probe", F.get(F.array_sort(F.transform(inner, lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t")))), F.lit(0))["t"])
    index = docs.select("doc_id", F.explode(F.array_distinct(search_terms(F.col("text")))).alias("probe"))
    pairs = index.join(probe.where("probe is not null"), "probe").select("doc_id", "item_id", "passage")
    found = pairs.join(docs, "doc_id").where(F.contains("text", "passage")).select(F.col("item_id").alias("query"), F.col("doc_id").alias("item"))
    short = docs.join(probe.where("probe is null and passage is not null"), F.contains("text", "passage")).select(F.col("item_id").alias("query"), F.col("doc_id").alias("item"))
    return found.unionByName(short)


@query(f"WITH {BM25} SELECT query AS item_id, item AS doc_id, rank::INT AS rank, round(score, 6) AS score FROM lex WHERE rank <= 5")
def r3_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexical(spark, sf_dir, 5)
    return hits.select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query(f"WITH {INDEX} SELECT term, df::BIGINT AS df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 8) AS idf FROM df, sizes")
def r1_term_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.search import postings

    docs = table(spark, sf_dir, "documents")
    df = postings(docs, "doc_id", search_terms(F.col("text"))).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 8).alias("idf"))


@query(f"WITH {INDEX}, {COVER} SELECT query AS item_id, item AS doc_id, rank::INT AS rank, overlap::BIGINT AS overlap, score FROM cover WHERE rank <= 5")
def r9_term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering(spark, sf_dir, 5).select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), "rank", "overlap", "score")


def _fusion_sql(a: float, b: float) -> str:
    return f"""WITH {BM25}, {COVER},
both_lists AS (SELECT query, item, rank, {a} AS w, 0 AS list FROM lex WHERE rank <= 20 UNION ALL SELECT query, item, rank, {b}, 1 FROM cover WHERE rank <= 20),
rrf AS (SELECT query, item, round(sum(w / (60 + rank)), 10) AS score, min(rank) AS best_rank, max(list) AS hi, min(list) AS lo FROM both_lists GROUP BY query, item),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, best_rank, item) AS rank FROM rrf)
SELECT query AS item_id, item AS doc_id, rank::INT AS rank, score, CASE WHEN lo < hi THEN 'hybrid' WHEN lo = 0 THEN 'first' ELSE 'second' END AS kind FROM ranked WHERE rank <= 5"""


def _fusion(spark: SparkSession, sf_dir: str, weights: tuple[float, float]) -> DataFrame:
    own = lexicon(spark, sf_dir)
    both = fused(own.bm25(20), own.coverage(20), weights)
    hits = top(both, 5, F.desc("score"), F.col("best_rank"), F.col("item"))
    return hits.select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), "rank", "score", "kind")


@query(_fusion_sql(1.0, 1.0))
def r7_rrf_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fusion(spark, sf_dir, (1.0, 1.0))


@query(_fusion_sql(0.9, 0.1))
def r7_rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fusion(spark, sf_dir, (0.9, 0.1))


@query(_fusion_sql(1.0, 0.0))
def r7_rrf_zero_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fusion(spark, sf_dir, (1.0, 0.0))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
s AS (SELECT q.vec_id AS query, i.vec_id AS item, round(list_cosine_similarity(q.e, i.e), 8) AS sim FROM v q JOIN v i ON q.vec_id % 100 = 0 AND i.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS rank FROM s)
SELECT query, item AS vec_id, rank::INT AS rank, round(sim, 6) AS sim FROM r WHERE rank <= 10""")
def r4_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all vectors for every vector whose id is divisible by 100, the stated query set."""
    from lodestone.operators.dense import nearest

    vectors = table(spark, sf_dir, "embeddings")
    hits = nearest(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding", 10)
    return hits.select("query", F.col("item").alias("vec_id"), "rank", F.round("sim", 6).alias("sim"))


MARKED = f"""WITH {BM25}, {GOLD},
hits AS (SELECT l.query, l.item, l.rank, g.item IS NOT NULL AS relevant FROM lex l LEFT JOIN gold g USING (query, item) WHERE l.rank <= 20),
questions AS (SELECT item_id AS query FROM benchmark),
wanted AS (SELECT query, count(DISTINCT item) AS wanted FROM gold GROUP BY query)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"))
    return metrics.judged(questions, lexical(spark, sf_dir, 20).select("query", "item", "rank"), gold(spark, sf_dir))


@query(MARKED + " SELECT query AS item_id, (min(rank) FILTER (WHERE relevant))::INT AS first_rank, coalesce(1.0 / min(rank) FILTER (WHERE relevant), 0)::DOUBLE AS rr FROM questions LEFT JOIN hits USING (query) GROUP BY query")
def m1_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reciprocal_rank(judged(spark, sf_dir)).select(F.col("query").alias("item_id"), "first_rank", "rr")


@query(MARKED + """, k AS (SELECT unnest([1, 3, 5, 10]) AS k),
per_k AS (SELECT query, k, count(*) FILTER (WHERE rank <= k AND relevant) AS found, count(*) FILTER (WHERE rank <= k) AS returned FROM questions LEFT JOIN hits USING (query), k GROUP BY query, k)
SELECT query AS item_id, k::INT AS k, (found > 0)::INT AS hit, round(found / wanted, 8) AS recall, round(found / nullif(returned, 0), 8) AS precision, returned::BIGINT AS returned
FROM per_k LEFT JOIN wanted USING (query)""")
def m3_m6_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.at_k(judged(spark, sf_dir), [1, 3, 5, 10])
    return rows.select(F.col("query").alias("item_id"), "k", "hit", F.round("recall", 8).alias("recall"), F.round("precision", 8).alias("precision"), "returned")


@query(MARKED + """, k AS (SELECT unnest([1, 3, 5, 10]) AS k),
per_k AS (SELECT query, k, count(*) FILTER (WHERE rank <= k AND relevant) AS found, count(*) FILTER (WHERE rank <= k) AS returned FROM questions LEFT JOIN hits USING (query), k GROUP BY query, k)
SELECT k::INT AS k, round(avg((found > 0)::INT), 8) AS mean_hit, round(avg(found / wanted), 8) AS mean_recall, count(wanted)::BIGINT AS recall_defined,
       round(avg(found / nullif(returned, 0)), 8) AS mean_precision, count(nullif(returned, 0))::BIGINT AS precision_defined FROM per_k LEFT JOIN wanted USING (query) GROUP BY k""")
def m7_scored_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.at_k(judged(spark, sf_dir), [1, 3, 5, 10]).groupBy("k")
    mean = lambda c: F.round(F.avg(c), 8).alias(f"mean_{c}")
    return rows.agg(mean("hit"), mean("recall"), F.count("recall").alias("recall_defined"), mean("precision"), F.count("precision").alias("precision_defined"))


@query(f"WITH {BM25}, l AS (SELECT doc_id AS item, max(quality) AS quality FROM labels GROUP BY doc_id),"
       """ c AS (SELECT query, item, rank, score, quality FROM lex LEFT JOIN l USING (item) WHERE rank <= 20),
n AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS norm FROM c WINDOW w AS (PARTITION BY query)),
f AS (SELECT *, round(CASE WHEN quality IS NULL THEN norm ELSE 0.8 * norm + 0.2 * quality END, 8) AS final FROM n)
SELECT query AS item_id, item AS doc_id, (row_number() OVER (PARTITION BY query ORDER BY final DESC, rank))::INT AS new_rank, round(norm, 6) AS norm, final FROM f""")
def k2_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max scores of each question's hits, mixed with a label; a hit without a label keeps its score."""
    from pyspark.sql import Window

    label = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("item")).agg(F.max("quality").alias("quality"))
    w = Window.partitionBy("query")
    low, high = F.min("score").over(w), F.max("score").over(w)
    rows = lexical(spark, sf_dir, 20).join(label, "item", "left").withColumn("norm", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))
    final = rows.withColumn("final", F.round(F.when(F.col("quality").isNull(), F.col("norm")).otherwise(0.8 * F.col("norm") + 0.2 * F.col("quality")), 8))
    rank = F.row_number().over(w.orderBy(F.desc("final"), "rank"))
    return final.select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), rank.alias("new_rank"), F.round("norm", 6).alias("norm"), "final")
