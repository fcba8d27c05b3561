"""Queries of screening and selection: term overlap, rare-term candidates, pairs, and reranking by roles and weights."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as texts
from lodestone.operators import metrics, screening
from lodestone.operators.search import fused, top
from lodestone.plans.search import BM25, COVER, GOLD, gold, lexical, lexicon
from lodestone.registry import query, table
from lodestone.sources.shared import written


def _in(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_STEM = "list_transform({0}, lambda t: CASE WHEN length(t) > 5 AND t LIKE '%ies' THEN t[:-4] || 'y' WHEN length(t) > 5 AND t LIKE '%ing' THEN t[:-4] WHEN length(t) > 4 AND t LIKE '%ed' THEN t[:-3] WHEN length(t) > 4 AND t LIKE '%s' AND NOT t LIKE '%ss' THEN t[:-2] ELSE t END)"
_STEMMED = "list_distinct(" + _STEM.format(f"list_filter(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-z0-9]+'), lambda t: t NOT IN ({_in(texts.COVERAGE_STOPS)}) AND length(t) > 1)") + ")"
_SCREEN = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({{0}}, '')), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({_in(texts.SCREENING_STOPS)})))"


@query(f"""WITH q AS (SELECT item_id AS query, unnest({_STEMMED}) AS term FROM benchmark), d AS (SELECT doc_id AS item, unnest({_STEMMED}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM d GROUP BY 1),
i AS (SELECT query, term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM q LEFT JOIN df USING (term), n), w AS (SELECT query, sum(idf) AS whole, count(*) AS terms FROM i GROUP BY 1), m AS (SELECT query, item, sum(idf) AS got, count(*) AS overlap FROM i JOIN d USING (term) GROUP BY ALL),
s AS (SELECT query, item, overlap, round(got / whole, 4) AS score FROM m JOIN w USING (query) WHERE overlap >= least(2, terms) AND round(got / whole, 4) >= 0.2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, overlap DESC, item) AS rank FROM s)
SELECT query AS item_id, item AS doc_id, rank::INT AS rank, overlap::BIGINT AS overlap, score FROM r WHERE rank <= 5""")
def r9_t5_stemmed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that cover most of a question's stemmed terms, by weight."""
    from lodestone.operators.search import coverage

    found = coverage(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id", texts.coverage_terms(F.col("text")), texts.coverage_terms(F.col("text")))
    return top(found, 5, F.desc("score"), F.desc("overlap"), F.col("item")).select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), "rank", "overlap", "score")


_LONG = "list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: length(t) >= 4))"


@query(f"""WITH q AS (SELECT item_id AS query, {_LONG} AS ts FROM benchmark), u AS (SELECT query, len(ts) AS n, unnest(ts) AS term FROM q), d AS (SELECT doc_id AS item, unnest({_LONG}) AS term FROM documents),
m AS (SELECT query, item, count(*) AS overlap, round(count(*) / any_value(n), 4) AS score FROM u JOIN d USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM m) SELECT query AS item_id, item AS doc_id, rank::INT AS rank, score FROM r WHERE rank <= 5""")
def r10_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share most of a question's long words."""
    terms = texts.long_words(F.col("text"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.size(terms).alias("n"), F.explode(terms).alias("term"))
    index = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.explode(terms).alias("term"))
    met = asked.join(index.join(asked.select("term").distinct(), "term", "left_semi"), "term").groupBy("query", "item").agg(F.round(F.count("*") / F.max("n"), 4).alias("score"))
    return top(met, 5, F.desc("score"), F.col("item")).select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), "rank", "score")


_BLOCKS = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l), b AS (SELECT doc_id * 100000 + line_no AS block, doc_id AS doc, s AS a, s + length(line) AS z, line AS text, {_SCREEN.format('line')} AS terms FROM o WHERE length(line) >= 20),
q AS (SELECT item_id AS query, {_SCREEN.format('text')} AS terms, array_to_string(list_slice(string_split(text, ' '), 2, 3), ' ') AS answer FROM benchmark WHERE text IS NOT NULL), qa AS (SELECT *, {_SCREEN.format('answer')} AS answer_terms FROM q),
ix AS (SELECT block, unnest(terms) AS term FROM b), df AS (SELECT term, count(*) AS df FROM ix GROUP BY 1), kn AS (SELECT query, t.term, coalesce(df, 0) AS df FROM (SELECT query, unnest(terms) AS term FROM qa) t LEFT JOIN df ON df.term = t.term),
ac AS (SELECT query, term FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY df, term) AS r FROM kn) WHERE r <= 12 UNION SELECT query, unnest(answer_terms) FROM qa), ca AS (SELECT DISTINCT query, block FROM ac JOIN ix USING (term)),
sc AS (SELECT query, block, doc, a, z, list_intersect(qa.terms, b.terms) AS shared, len(qa.terms) AS n_terms, round(0.62::DOUBLE * len(list_intersect(qa.terms, b.terms)) / greatest(len(qa.terms), 1) + 0.28::DOUBLE * sqrt(len(list_intersect(qa.terms, b.terms)) / greatest(len(b.terms), 1)) + CASE WHEN len(answer_terms) > 0 AND list_has_all(b.terms, answer_terms) THEN 0.32::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), lower(answer)) THEN 0.28::DOUBLE ELSE 0 END, 8) AS score,
round(len(list_intersect(qa.terms, b.terms)) / greatest(len(qa.terms), 1), 8) AS overlap, (len(answer_terms) > 0 AND list_has_all(b.terms, answer_terms)) OR contains(lower(text), lower(answer)) AS has_answer FROM ca JOIN b USING (block) JOIN qa USING (query)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, overlap DESC, has_answer DESC, block) AS rank FROM sc)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of twenty characters or more as blocks: (block, doc, start, end, text, block_terms)."""
    from lodestone.operators.spans import line_spans

    lines = line_spans(table(spark, sf_dir, "documents")).where(F.char_length("line") >= 20)
    return lines.select((F.col("doc") * 100000 + F.col("line_no")).alias("block"), "doc", "start", "end", F.col("line").alias("text"), texts.screening_terms(F.col("line")).alias("block_terms"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, terms, answer, answer_terms) of every benchmark text; its second and third word stand for an answer."""
    answer = F.array_join(F.slice(F.split("text", " ", -1), 2, 2), " ")
    asked = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("query"), texts.screening_terms(F.col("text")).alias("terms"), answer.alias("answer"))
    return asked.withColumn("answer_terms", texts.screening_terms(F.col("answer")))


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks for every benchmark text, best first."""
    asked, held = questions(spark, sf_dir), blocks(spark, sf_dir)
    pairs = screening.candidates(asked, held.select("block", F.col("block_terms").alias("terms"))).join(held, "block").join(asked, "query")
    rows = screening.scored(pairs)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("overlap"), F.desc("has_answer"), "block")))


def pooled(spark: SparkSession, sf_dir: str, k: int, carry: list[str]) -> DataFrame:
    """The first k of screened(), with the terms of their questions where terms are carried; written, as they are few."""
    asked = questions(spark, sf_dir)
    rows = screening.best(asked, blocks(spark, sf_dir), k, carry)
    return written(rows.join(asked.select("query", "terms"), "query") if "block_terms" in carry else rows)


@query(f"WITH {_BLOCKS} SELECT query AS item_id, block, rank::INT AS rank, score, overlap, has_answer FROM rk WHERE rank <= 10")
def r11_r12_screened_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best blocks for each question, out of those that its rarest terms and its answer's terms lead to."""
    return screened(spark, sf_dir).where("rank <= 10").select(F.col("query").alias("item_id"), "block", "rank", "score", "overlap", "has_answer")


@query(f"WITH {_BLOCKS}, pool AS (SELECT * FROM rk WHERE rank <= 15), pr AS (SELECT x.query, x.doc, x.rank, y.rank AS o_rank, round(0.62::DOUBLE * len(list_distinct(list_concat(x.shared, y.shared))) / greatest(x.n_terms, 1) + 0.18::DOUBLE * greatest(x.score, y.score), 8) AS pair_score FROM pool x JOIN pool y ON x.query = y.query AND x.doc = y.doc AND x.rank < y.rank AND abs(x.a - y.z) <= 1800)"
       " SELECT query AS item_id, doc AS doc_id, rank::INT AS first, o_rank::INT AS second, pair_score FROM pr QUALIFY row_number() OVER (PARTITION BY query ORDER BY pair_score DESC, rank, o_rank) = 1")
def r14_j11_best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two blocks of one document, not far apart, that together cover most of a question."""
    pool = pooled(spark, sf_dir, screening.PAIR_POOL, ["doc", "start", "end", "block_terms"])
    ranked = pool.withColumn("shared", F.array_intersect("terms", "block_terms")).withColumn("n_terms", F.size("terms"))
    return screening.best_pairs(ranked).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.col("rank").alias("first"), F.col("o_rank").alias("second"), "pair_score")


@query(f"WITH {_BLOCKS}, pool AS (SELECT rk.*, b.text, b.terms FROM rk JOIN b USING (block) WHERE rank <= 15) SELECT x.query AS item_id, x.rank::INT AS first, y.rank::INT AS second, round(len(list_intersect(x.terms, y.terms)) / greatest(len(list_distinct(list_concat(x.terms, y.terms))), 1), 8) AS jaccard,"
       " len(list_intersect(x.terms, y.terms)) / greatest(len(list_distinct(list_concat(x.terms, y.terms))), 1) >= 0.78 OR contains(lower(x.text), lower(y.text)) OR contains(lower(y.text), lower(x.text)) AS same, len(list_filter(y.shared, lambda t: NOT list_contains(x.shared, t)))::INT AS added FROM pool x JOIN pool y ON x.query = y.query AND x.doc = y.doc AND x.rank < y.rank")
def r15_r16_pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a question's best blocks in one document: how alike they are, and which terms of the question the second adds."""
    pool = pooled(spark, sf_dir, 15, ["doc", "lowered", "block_terms"]).select("query", "doc", "rank", "lowered", "block_terms", F.array_intersect("terms", "block_terms").alias("shared"))
    other = pool.select("query", "doc", *[F.col(c).alias(f"o_{c}") for c in ("rank", "lowered", "block_terms", "shared")])
    met = pool.join(other, ["query", "doc"]).where("rank < o_rank")
    jaccard = F.size(F.array_intersect("block_terms", "o_block_terms")) / F.greatest(F.size(F.array_union("block_terms", "o_block_terms")), F.lit(1))
    a, b = F.col("lowered"), F.col("o_lowered")
    return met.select(F.col("query").alias("item_id"), F.col("rank").alias("first"), F.col("o_rank").alias("second"), F.round(jaccard, 8).alias("jaccard"), ((jaccard >= screening.ALIKE) | F.contains(a, b) | F.contains(b, a)).alias("same"), F.size(F.array_except("o_shared", "shared")).alias("added"))


@query()
def r13_suppressed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's five best blocks, none of which overlaps a better one of its document by much."""
    ranked = pooled(spark, sf_dir, 60, ["doc", "start", "end"]).select("query", "rank", "doc", "start", "end", "block", "score")
    return screening.suppressed(ranked, 5)


@query(f"WITH {_BLOCKS}, ok AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS turn FROM rk WHERE has_answer AND overlap >= 0.2) SELECT query AS item_id, block, rank::INT AS rank, turn::INT AS turn FROM ok WHERE turn <= 3")
def r21_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three blocks of each question that hold its answer and enough of its terms: a quota is the feature."""
    fit = screened(spark, sf_dir).where("has_answer and overlap >= 0.2").withColumn("turn", F.row_number().over(Window.partitionBy("query").orderBy("rank")))
    return fit.where("turn <= 3").select(F.col("query").alias("item_id"), "block", "rank", "turn")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query, i.vec_id AS item, round(list_cosine_similarity(q.e, i.e), 8) AS sim FROM v q JOIN v i ON q.vec_id % 100 = 0 AND i.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, item) AS rank FROM s) SELECT query, item AS vec_id, rank::INT AS rank, round(sim, 6) AS sim FROM r WHERE rank <= 10 AND sim >= 0.3""")
def r4_dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ten nearest vectors those that are near enough: fewer than ten is right. The queries are every id divisible by 100."""
    from lodestone.operators.dense import nearest

    vectors = table(spark, sf_dir, "embeddings")
    hits = nearest(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding", 10, least=0.3)
    return hits.select("query", F.col("item").alias("vec_id"), "rank", F.round("sim", 6).alias("sim"))


@query("SELECT vec_id, len(embedding)::INT AS dim, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS length, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0 AND NOT isnan(list_sum(embedding::DOUBLE[])) AS usable FROM embeddings WHERE embedding IS NOT NULL")
def r5_vector_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of vectors, and which can be brought to length 1."""
    vec = F.col("embedding").cast("array<double>")
    squares = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x)
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.size(vec).alias("dim"), F.round(F.sqrt(squares), 6).alias("length"), ((squares > 0) & ~F.isnan(squares)).alias("usable"))


# Roles that each level prefers.
PREFERRED = {"beginner": ("definition", "example"), "intermediate": ("comparison", "application"), "advanced": ("derivation", "boundary")}
_ROLES = """lab AS (SELECT doc_id AS item, CASE WHEN count(*) = 1 AND max(coalesce(toxic, 0)) = 0 THEN any_value(CASE WHEN quality = 1 THEN ['definition', 'comparison', 'derivation'][(doc_id % 3 + 1)::INT] ELSE ['example', 'application', 'boundary'][(doc_id % 3 + 1)::INT] END) END AS role, count(*) > 1 OR max(coalesce(toxic, 0)) = 1 AS several FROM labels GROUP BY 1),
lev AS (SELECT * FROM (VALUES ('beginner', ['definition', 'example']), ('intermediate', ['comparison', 'application']), ('advanced', ['derivation', 'boundary'])) t(level, preferred)),
cand AS (SELECT query, item, rank, score, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS norm FROM lex WHERE rank <= 20 WINDOW w AS (PARTITION BY query)),
rr AS (SELECT query, item, rank, level, l.lam, norm, role, preferred, round(CASE WHEN role IS NULL THEN norm ELSE (1 - l.lam * conf) * norm + l.lam * conf * list_contains(preferred, role)::INT END, 8) AS final, CASE WHEN role IS NULL THEN CASE WHEN several THEN 'ambiguous_label' ELSE 'missing_label' END END AS fallback
 FROM (SELECT *, coalesce([NULL, 0.5, 1.0][(query % 3 + 1)::INT], 0.0)::DOUBLE AS conf FROM cand) c CROSS JOIN lev CROSS JOIN (SELECT unnest([0.0, 0.1, 0.2, 0.4]::DOUBLE[]) AS lam) l LEFT JOIN lab USING (item)),
rd AS (SELECT *, row_number() OVER (PARTITION BY query, level, lam ORDER BY final DESC, rank, item) AS place FROM rr)"""
LAMBDAS = (0.0, 0.1, 0.2, 0.4)


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, role, several): labels as roles of documents; several labels, or a toxic one beside it, are ambiguous."""
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 3 + 1).cast("int"))
    role = F.when(F.col("quality") == 1, pick("definition", "comparison", "derivation")).otherwise(pick("example", "application", "boundary"))
    per = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.any_value(role).alias("role"))
    several = (F.col("n") > 1) | (F.col("toxic") == 1)
    return per.select(F.col("doc_id").alias("item"), F.when(~several, F.col("role")).alias("role"), several.alias("several"))


def reranked(spark: SparkSession, sf_dir: str, lambdas: tuple[float, ...] = LAMBDAS) -> DataFrame:
    """Twenty hits of each question in new places, by level and by the weight of a fitting role; a question's confidence scales the weight.

    A hit without one clear role keeps its score, so that it neither gains nor loses.
    """
    w = Window.partitionBy("query")
    low, high = F.min("score").over(w), F.max("score").over(w)
    hits = lexical(spark, sf_dir, 20).withColumn("norm", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))
    levels = F.explode(F.create_map(*[x for k, v in PREFERRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])).alias("level", "preferred")
    confidence = F.when(F.col("query") % 3 == 1, 0.5).when(F.col("query") % 3 == 2, 1.0).otherwise(0.0)
    spread = hits.withColumn("lambda", F.explode(F.array(*map(F.lit, lambdas)))).select("query", "item", "rank", "norm", "lambda", levels).join(roles(spark, sf_dir), "item", "left")
    weight = F.col("lambda") * confidence
    match = F.array_contains("preferred", F.col("role")).cast("int")
    rows = spread.withColumn("final", F.round(F.when(F.col("role").isNull(), F.col("norm")).otherwise((1 - weight) * F.col("norm") + weight * match), 8))
    rows = rows.withColumn("fallback", F.when(F.col("role").isNull(), F.when(F.coalesce("several", F.lit(False)), "ambiguous_label").otherwise("missing_label")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query", "level", "lambda").orderBy(F.desc("final"), "rank", "item")))


@query(f"WITH {BM25}, {_ROLES} SELECT query AS item_id, item AS doc_id, level, place::INT AS place, final, role, fallback FROM rd WHERE lam = 0.2")
def k2_k3_role_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir, (0.2,)).select(F.col("query").alias("item_id"), F.col("item").alias("doc_id"), "level", "place", "final", "role", "fallback")


@query(f"WITH {BM25}, {_ROLES}, c AS (SELECT unnest(['P0R0', 'P1R0', 'P0R1', 'P1R1']) AS condition) SELECT condition, level, count(*)::BIGINT AS cells, round(avg(list_contains(preferred, role)::INT), 8) AS preferred_share, count(role)::BIGINT AS labelled FROM rd JOIN c ON lam = CASE WHEN condition LIKE '%R1' THEN 0.2 ELSE 0.0 END WHERE place <= 5 GROUP BY ALL")
def k4_k10_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four arms of prompt and rerank: how often the five best hits have a role that the level prefers."""
    rows = reranked(spark, sf_dir, (0.0, 0.2)).where("place <= 5")
    arms = F.explode(F.when(F.col("lambda") > 0, F.array(F.lit("P0R1"), F.lit("P1R1"))).otherwise(F.array(F.lit("P0R0"), F.lit("P1R0"))))
    fit = F.array_contains("preferred", F.col("role")).cast("int")
    return rows.withColumn("condition", arms).groupBy("condition", "level").agg(F.count("*").alias("cells"), F.round(F.avg(fit), 8).alias("preferred_share"), F.count("role").alias("labelled"))


@query(f"WITH {BM25}, {_ROLES}, f AS (SELECT level, query, max(coalesce(list_contains(preferred, role), false)) AS rich FROM rd WHERE lam = 0 GROUP BY ALL) SELECT level, round(avg(rich::INT), 8) AS richness, count(*)::BIGINT AS questions FROM f GROUP BY 1")
def k12_role_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with at least one hit of a preferred role, by level."""
    per = reranked(spark, sf_dir, (0.0,)).groupBy("level", "query").agg(F.max(F.coalesce(F.array_contains("preferred", F.col("role")), F.lit(False))).alias("rich"))
    return per.groupBy("level").agg(F.round(F.avg(F.col("rich").cast("int")), 8).alias("richness"), F.count("*").alias("questions"))


@query(f"WITH {BM25}, {_ROLES} SELECT count(*)::BIGINT AS refs, count(role)::BIGINT AS labelled_refs, count(DISTINCT item)::BIGINT AS items, count(DISTINCT CASE WHEN role IS NOT NULL THEN item END)::BIGINT AS labelled_items FROM cand LEFT JOIN lab USING (item)")
def k7_label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical(spark, sf_dir, 20).join(roles(spark, sf_dir), "item", "left")
    return rows.agg(F.count("*").alias("refs"), F.count("role").alias("labelled_refs"), F.countDistinct("item").alias("items"), F.countDistinct(F.when(F.col("role").isNotNull(), F.col("item"))).alias("labelled_items"))


WEIGHTS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
_SWEEP = f"""WITH {BM25}, {COVER}, {GOLD}, ws AS (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]::DOUBLE[]) AS w), bl AS (SELECT query, item, rank, 0 AS list FROM lex WHERE rank <= 20 UNION ALL SELECT query, item, rank, 1 FROM cover WHERE rank <= 20),
rf AS (SELECT w, query, item, round(sum(CASE list WHEN 0 THEN w ELSE 1 - w END / (60 + rank)), 10) AS score, min(rank) AS best FROM bl, ws GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY w, query ORDER BY score DESC, best, item) AS rank FROM rf),
ft AS (SELECT w, query, min(rank) AS first FROM rk JOIN gold USING (query, item) GROUP BY ALL), wanted AS (SELECT DISTINCT query FROM gold), pq AS (SELECT ws.w, wanted.query, coalesce((first <= 5)::INT, 0) AS hit, coalesce(1.0::DOUBLE / first, 0) AS rr FROM ws CROSS JOIN wanted LEFT JOIN ft ON ft.w = ws.w AND ft.query = wanted.query)"""


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(w, query, hit, rr) for each weight of the first of two rankings, over questions that have an answer. Both are ranked once for all weights."""
    own = lexicon(spark, sf_dir)
    parts = [r.select("query", "item", "rank", F.lit(i).alias("list")) for i, r in enumerate((own.bm25(20), own.coverage(20)))]
    spread = parts[0].unionByName(parts[1]).withColumn("w", F.explode(F.array(*map(F.lit, WEIGHTS))))
    share = F.when(F.col("list") == 0, F.col("w")).otherwise(1 - F.col("w"))
    scores = spread.groupBy("w", "query", "item").agg(F.round(F.sum(share / (60 + F.col("rank"))), 10).alias("score"), F.min("rank").alias("best"))
    ranked = scores.withColumn("place", F.row_number().over(Window.partitionBy("w", "query").orderBy(F.desc("score"), "best", "item")))
    # one look at the gold pairs: what is found and what is wanted come from the same join
    wanted = gold(spark, sf_dir).distinct().withColumn("w", F.explode(F.array(*map(F.lit, WEIGHTS))))
    met = wanted.join(ranked, ["w", "query", "item"], "left").groupBy("w", "query").agg(F.min("place").alias("first"))
    return met.select("w", "query", F.coalesce((F.col("first") <= 5).cast("int"), F.lit(0)).alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


@query(_SWEEP + " SELECT w, sum(hit)::BIGINT AS hits, count(*)::BIGINT AS questions, round(avg(rr), 8) AS mrr, (row_number() OVER (ORDER BY sum(hit) DESC, round(avg(rr), 8) DESC, w))::INT AS place FROM pq GROUP BY w")
def k13_weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by questions answered in the first five hits, then by mean reciprocal rank."""
    sums = sweep(spark, sf_dir).groupBy("w").agg(F.sum("hit").alias("hits"), F.count("*").alias("questions"), F.round(F.avg("rr"), 8).alias("mrr"))
    return sums.withColumn("place", F.row_number().over(Window.orderBy(F.desc("hits"), F.desc("mrr"), "w")))


@query(_SWEEP + ", st AS (SELECT w, query % 2 AS part, sum(hit) AS hits, count(*) AS n, avg(rr) AS mrr FROM pq GROUP BY ALL), js AS (SELECT w, sum(hits)::BIGINT AS hits, round(sum(mrr * n) / sum(n), 8) AS mrr, count(*)::BIGINT AS sets FROM st GROUP BY 1) SELECT w, hits, mrr, sets, (row_number() OVER (ORDER BY hits DESC, mrr DESC, w))::INT AS place FROM js")
def k14_joint_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weight for two sets of questions (odd and even ids): hits together, reciprocal ranks weighted by questions."""
    per_set = sweep(spark, sf_dir).groupBy("w", (F.col("query") % 2).alias("part")).agg(F.sum("hit").alias("hits"), F.count("*").alias("n"), F.avg("rr").alias("mrr"))
    joint = per_set.groupBy("w").agg(F.sum("hits").alias("hits"), F.round(F.sum(F.col("mrr") * F.col("n")) / F.sum("n"), 8).alias("mrr"), F.count("*").alias("sets"))
    return joint.withColumn("place", F.row_number().over(Window.orderBy(F.desc("hits"), F.desc("mrr"), "w")))


@query(_SWEEP + ", h AS (SELECT w, sum(hit) AS hits, count(*) AS n FROM pq GROUP BY 1), b AS (SELECT hits AS base FROM h WHERE w = 1.0) SELECT w, hits::BIGINT AS hits, 100 * hits >= 100 * base - n AS by_counts, round(base / n - hits / n, 8) <= 0.01 AS by_rates FROM h, b")
def k9_harmless_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which weights lose at most a hundredth of the first ranking's hits: by integer counts, and by rates as a check."""
    sums = sweep(spark, sf_dir).groupBy("w").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    base = sums.where("w = 1.0").select(F.col("hits").alias("base"))
    rows = sums.crossJoin(F.broadcast(base))
    return rows.select("w", "hits", (100 * F.col("hits") >= 100 * F.col("base") - F.col("n")).alias("by_counts"), (F.round(F.col("base") / F.col("n") - F.col("hits") / F.col("n"), 8) <= 0.01).alias("by_rates"))
