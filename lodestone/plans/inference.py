"""Queries of inference: resampled intervals, model comparison, noise floors, balance checks, merges, group-safe splits and picks."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as texts
from lodestone.functions import unicode
from lodestone.operators import merging, stats
from lodestone.operators.ranking import placed
from lodestone.plans.search import BM25, COVER, GOLD, gold, lexicon
from lodestone.registry import query, table
from lodestone.sources.shared import written

_CLUSTERS = """c AS (SELECT o_custkey, avg((o_totalprice > 150000)::INT) FILTER (WHERE o_orderpriority < '3') AS a, avg((o_totalprice > 150000)::INT) FILTER (WHERE o_orderpriority >= '3') AS b FROM orders GROUP BY 1),
d AS (SELECT o_custkey, a - b AS diff, row_number() OVER (ORDER BY o_custkey) - 1 AS place, count(*) OVER () AS n FROM c WHERE a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT draw, slot, ('0x' || substr(md5('boot|' || draw || '|' || slot), 1, 8))::BIGINT % (SELECT max(n) FROM d) AS pick FROM range(100) t(draw), (SELECT place AS slot FROM d)),
m AS (SELECT draw, avg(diff) AS mean FROM s JOIN d ON d.place = s.pick GROUP BY 1), e AS (SELECT avg(diff) AS est, count(*) AS clusters FROM d)"""


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, diff): by customer, how much more often an urgent order is large than another."""
    large = (F.col("o_totalprice") > 150000).cast("int")
    arm = lambda c: F.avg(F.when(c, large))
    both = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(arm(F.col("o_orderpriority") < "3").alias("a"), arm(F.col("o_orderpriority") >= "3").alias("b"))
    return both.where("a is not null and b is not null").select("o_custkey", (F.col("a") - F.col("b")).alias("diff"))


def resampled(clusters: DataFrame, key: str, value: str, draws: int, seed: str) -> DataFrame:
    """(draw, mean): each draw takes as many clusters as there are, with replacement, by a hash of draw and slot.

    Clusters are numbered without one sorted task, and a draw's slots are counted by the cluster they hit before they meet it.
    """
    numbered = placed(clusters.select(key, value), key).select((F.col("place") - 1).alias("pick"), value)
    n = clusters.agg(F.count("*").alias("n"))
    slots = numbered.select(F.col("pick").alias("slot")).crossJoin(F.broadcast(n)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    hits = slots.groupBy("draw", (stats.draw(seed, F.col("draw"), F.col("slot")) % F.col("n")).alias("pick")).agg(F.count("*").alias("times"))
    return hits.join(numbered, "pick").groupBy("draw").agg((F.sum(F.col("times") * F.col(value)) / F.sum("times")).alias("mean"))


@query(f"WITH {_CLUSTERS} SELECT (SELECT round(est, 8) FROM e) AS estimate, (SELECT clusters FROM e)::BIGINT AS clusters, count(*)::BIGINT AS draws, round(quantile_cont(mean, 0.025), 8) AS low, round(quantile_cont(mean, 0.975), 8) AS high,"
       " round((1 + count(*) FILTER (WHERE abs(round(mean - (SELECT est FROM e), 12)) >= abs(round((SELECT est FROM e), 12)))) / (count(*) + 1), 8) AS p, quantile_cont(mean, 0.025) > -0.05 AS not_inferior FROM m")
def q2_q3_q5_resampled_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A difference with the interval and the two-sided p of resampled clusters, and whether it is surely no worse than by a twentieth."""
    clusters = differences(spark, sf_dir)
    est = clusters.agg(F.avg("diff").alias("est"), F.count("*").alias("clusters"))
    means = resampled(clusters, "o_custkey", "diff", 100, "boot").crossJoin(F.broadcast(est))
    far = F.count_if(F.abs(F.round(F.col("mean") - F.col("est"), 12)) >= F.abs(F.round("est", 12)))
    out = means.agg(F.round(F.first("est"), 8).alias("estimate"), F.first("clusters").alias("clusters"), F.count("*").alias("draws"), F.percentile("mean", 0.025).alias("l"), F.percentile("mean", 0.975).alias("h"), far.alias("far"))
    return out.select("estimate", "clusters", "draws", F.round("l", 8).alias("low"), F.round("h", 8).alias("high"), F.round((1 + F.col("far")) / (F.col("draws") + 1), 8).alias("p"), (F.col("l") > -0.05).alias("not_inferior"))


_HITS = f"""WITH {BM25}, {COVER}, {GOLD}, w AS (SELECT DISTINCT query FROM gold), x AS (SELECT query, min(rank) AS first FROM lex JOIN gold USING (query, item) WHERE rank <= 20 GROUP BY 1), y AS (SELECT query, min(rank) AS first FROM cover JOIN gold USING (query, item) WHERE rank <= 20 GROUP BY 1),
p AS (SELECT w.query, coalesce(x.first <= 5, false) AS a, coalesce(y.first <= 5, false) AS b, coalesce(1.0::DOUBLE / x.first, 0) AS ra, coalesce(1.0::DOUBLE / y.first, 0) AS rb FROM w LEFT JOIN x USING (query) LEFT JOIN y USING (query))"""


def paired_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, a, b, ra, rb): whether and how early two rankings find an answer, for questions that have one."""
    own = lexicon(spark, sf_dir)
    lists = own.bm25(20).select("query", "item", "rank", F.lit(0).alias("list")).unionByName(own.coverage(20).select("query", "item", "rank", F.lit(1).alias("list")))
    met = gold(spark, sf_dir).distinct().join(lists, ["query", "item"], "left")
    first = lambda i: F.min(F.when(F.col("list") == i, F.col("rank")))
    firsts = met.groupBy("query").agg(first(0).alias("x"), first(1).alias("y"))
    hit, rr = lambda c: F.coalesce(F.col(c) <= 5, F.lit(False)), lambda c: F.coalesce(1.0 / F.col(c), F.lit(0.0))
    return firsts.select("query", hit("x").alias("a"), hit("y").alias("b"), rr("x").alias("ra"), rr("y").alias("rb"))


@query(_HITS + " SELECT count(*)::BIGINT AS questions, count(*) FILTER (WHERE a AND NOT b)::BIGINT AS only_first, count(*) FILTER (WHERE b AND NOT a)::BIGINT AS only_second, round(avg(rb - ra), 8) AS mrr_gain, count(*) FILTER (WHERE b AND NOT a) > count(*) FILTER (WHERE a AND NOT b) AND avg(rb) > avg(ra) AS replace FROM p")
def q9_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that only one of two rankings answers, and whether the second should replace the first: more answers and earlier ones."""
    n = lambda c, name: F.count_if(c).alias(name)
    a, b = F.col("a"), F.col("b")
    out = paired_hits(spark, sf_dir).agg(F.count("*").alias("questions"), n(a & ~b, "only_first"), n(b & ~a, "only_second"), F.round(F.avg(F.col("rb") - F.col("ra")), 8).alias("mrr_gain"), (F.avg("rb") > F.avg("ra")).alias("earlier"))
    return out.select("questions", "only_first", "only_second", "mrr_gain", ((F.col("only_second") > F.col("only_first")) & F.col("earlier")).alias("replace"))


@query(_HITS + """, d AS (SELECT query, rb - ra AS diff, row_number() OVER (ORDER BY query) - 1 AS place, count(*) OVER () AS n FROM p), s AS (SELECT draw, ('0x' || substr(md5('rows|' || draw || '|' || place), 1, 8))::BIGINT % n AS pick FROM range(100) t(draw), d), m AS (SELECT draw, avg(diff) AS mean FROM s JOIN d ON d.place = s.pick GROUP BY 1)
SELECT count(*)::BIGINT AS draws, round(quantile_cont(mean, 0.025), 8) AS low, round(quantile_cont(mean, 0.975), 8) AS high FROM m""")
def q10_row_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of two rankings' difference in reciprocal ranks, questions resampled."""
    rows = paired_hits(spark, sf_dir).select("query", (F.col("rb") - F.col("ra")).alias("diff"))
    means = resampled(rows, "query", "diff", 100, "rows")
    return means.agg(F.count("*").alias("draws"), F.round(F.percentile("mean", 0.025), 8).alias("low"), F.round(F.percentile("mean", 0.975), 8).alias("high"))


@query("""WITH g AS (SELECT p_size % 3 AS target, CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE (p_partkey % 3)::INT END AS guess FROM part), t AS (SELECT target, count(*) AS n FROM g GROUP BY 1), s AS (SELECT count(*) AS n, avg((target = guess)::INT) AS acc, count(*) FILTER (WHERE guess >= 0) AS decided FROM g)
SELECT n::BIGINT AS n, decided::BIGINT AS decided, round(acc, 8) AS accuracy, round(abs(acc - 1/3), 8) AS deviation, (SELECT count(*) = 3 FROM t) AS covered, (SELECT count(DISTINCT n) = 1 FROM t) AS balanced, round((n - decided) / n, 8) AS uncertain_rate, abs(acc - 1/3) <= 0.05 AND (SELECT count(*) = 3 AND count(DISTINCT n) = 1 FROM t) AS passed FROM s""")
def q15_level_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether guesses of three levels are no better than chance, on rows whose levels are balanced."""
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 3).cast("int").alias("target"), F.when(F.col("p_partkey") % 11 == 0, -1).otherwise((F.col("p_partkey") % 3).cast("int")).alias("guess"))
    levels = rows.groupBy("target").agg(F.count("*").alias("m"), F.count_if(F.col("target") == F.col("guess")).alias("right"), F.count_if(F.col("guess") >= 0).alias("d"))
    s = levels.agg(F.sum("m").alias("n"), F.sum("d").alias("decided"), (F.sum("right") / F.sum("m")).alias("acc"), (F.count("*") == 3).alias("covered"), (F.min("m") == F.max("m")).alias("balanced"))
    off = F.abs(F.col("acc") - F.lit(1) / F.lit(3))
    return s.select("n", "decided", F.round("acc", 8).alias("accuracy"), F.round(off, 8).alias("deviation"), "covered", "balanced", F.round((F.col("n") - F.col("decided")) / F.col("n"), 8).alias("uncertain_rate"), ((off <= 0.05) & F.col("covered") & F.col("balanced")).alias("passed"))


@query("""WITH t AS (SELECT conv_id, md5(min_by(text, turn)) AS prompt, md5(max_by(text, turn)) AS answer, max(turn) AS turns FROM conversations GROUP BY 1), a AS (SELECT prompt, answer, count(*) AS m FROM t GROUP BY ALL), p AS (SELECT prompt, sum(m) AS n, sum(m * (m - 1) // 2) AS same FROM a GROUP BY 1)
SELECT (SELECT count(*) FROM t)::BIGINT AS runs, sum(n * (n - 1) // 2)::BIGINT AS pairs, sum(n * (n - 1) // 2 - same)::BIGINT AS mismatched, round(sum(n * (n - 1) // 2 - same) / nullif(sum(n * (n - 1) // 2), 0), 8) AS floor FROM p""")
def q21_q25_prompt_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of conversations that begin with the same bytes, and how many end otherwise: from counts, without pairs being made."""
    runs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.min_by("text", "turn").cast("binary")).alias("prompt"), F.md5(F.max_by("text", "turn").cast("binary")).alias("answer"))
    each = runs.groupBy("prompt", "answer").agg(F.count("*").alias("m"))
    pairs = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    per = each.groupBy("prompt").agg(F.sum("m").alias("n"), F.sum(pairs("m")).alias("same"))
    out = per.agg(F.sum("n").alias("runs"), F.sum(pairs("n")).alias("pairs"), F.sum(pairs("n") - F.col("same")).alias("mismatched"))
    return out.select("runs", "pairs", "mismatched", F.round(F.try_divide("mismatched", "pairs"), 8).alias("floor"))


@query("""WITH o AS (SELECT o_custkey, (o_totalprice > 150000) AS good, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, o_orderpriority AS kind FROM orders), p AS (SELECT x.kind, x.good = y.good AS same, x.good AND NOT y.good AS caught FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND y.r = x.r + 1)
SELECT kind, count(*)::BIGINT AS pairs, round(avg(same::INT), 8) AS consistency, round(avg(caught::INT), 8) AS detection, avg(same::INT) >= 0.4 AND avg(caught::INT) >= 0.1 AS passed FROM p GROUP BY GROUPING SETS ((kind), ())""")
def q17_q19_paired_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring runs of a customer: how often the verdict is the same and how often a fall is caught, and whether both are enough."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    good = F.col("o_totalprice") > 150000
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), good.alias("good"), F.lead(good).over(by).alias("next")).where("next is not null")
    same, caught = (F.col("good") == F.col("next")).cast("int"), (F.col("good") & ~F.col("next")).cast("int")
    return rows.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("pairs"), F.round(F.avg(same), 8).alias("consistency"), F.round(F.avg(caught), 8).alias("detection"), ((F.avg(same) >= 0.4) & (F.avg(caught) >= 0.1)).alias("passed"))


_TITLE = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\s+', ' ', 'g'))"


@query(f"SELECT {_TITLE.format('p_name')} AS title, count(DISTINCT p_name)::BIGINT AS variants, count(*)::BIGINT AS sources, count(DISTINCT p_brand)::BIGINT AS sections, min(p_partkey) AS first FROM part GROUP BY 1")
def d6_exact_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that are the same but for case and spaces: variants, sources and sections of each."""
    keyed = table(spark, sf_dir, "part").select(texts.title_key(F.col("p_name")).alias("title"), "p_name", "p_brand", "p_partkey")
    return keyed.groupBy("title").agg(F.countDistinct("p_name").alias("variants"), F.count("*").alias("sources"), F.countDistinct("p_brand").alias("sections"), F.min("p_partkey").alias("first"))


@query()
def d7_j12_near_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that begin alike and are nearly the same, for a person to look at."""
    titles = table(spark, sf_dir, "part").select(texts.title_key(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("title"))
    return merging.near_titles(titles, distinctive=merging.DISTINCTIVE)


@query(f"""WITH r AS (SELECT p_partkey, {_TITLE.format('p_type')} AS title_key, p_brand AS context FROM part), a AS (SELECT DISTINCT title_key, 'topic-' || substr(title_key, 1, 5) AS topic FROM r WHERE length(title_key) % 2 = 0), c AS (SELECT DISTINCT title_key, context, 'inside-' || context AS topic FROM r WHERE context LIKE '%1')
SELECT coalesce(c.topic, a.topic, r.title_key) AS topic, count(*)::BIGINT AS parts, count(DISTINCT r.title_key)::BIGINT AS titles FROM r LEFT JOIN c ON c.title_key = r.title_key AND c.context = r.context LEFT JOIN a ON a.title_key = r.title_key GROUP BY 1""")
def d8_alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles merged by a map of aliases, which a map for their context overrides."""
    rows = table(spark, sf_dir, "part").select("p_partkey", texts.title_key(F.col("p_type")).alias("title_key"), F.col("p_brand").alias("context"))
    aliases = rows.where(F.char_length("title_key") % 2 == 0).select("title_key", F.concat(F.lit("topic-"), F.substring("title_key", 1, 5)).alias("topic")).distinct()
    inside = rows.where(F.col("context").endswith("1")).select("title_key", "context", F.concat(F.lit("inside-"), "context").alias("topic")).distinct()
    return merging.merged_titles(rows, aliases, inside).groupBy("topic").agg(F.count("*").alias("parts"), F.countDistinct("title_key").alias("titles"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, md5(x) AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE length(x) >= 40), s AS (SELECT h, min(doc_id) AS root FROM l GROUP BY 1), e AS (SELECT DISTINCT doc_id AS a, root AS b FROM l JOIN s USING (h)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1), d AS (SELECT doc_id, coalesce(component, doc_id) AS component FROM documents LEFT JOIN c ON c.node = doc_id)
SELECT doc_id, component, CASE WHEN ('0x' || substr(md5('split|' || component), 1, 8))::BIGINT % 5 < 4 THEN 'dev' ELSE 'test' END AS split FROM d""")
def o4_group_safe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two splits of four and one fifths, none of which shares a long line with the other: whole components are dealt, by hash."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("x")).where(F.char_length("x") >= 40).select("doc_id", F.md5(F.col("x").cast("binary")).alias("h"))
    roots = written(lines.groupBy("h").agg(F.min("doc_id").alias("b")))
    edges = lines.join(roots, "h").select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct()
    found = merging.components(edges, written)
    rows = docs.select("doc_id").join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    return rows.withColumn("split", F.when(stats.draw("split", F.col("component")) % 5 < 4, "dev").otherwise("test"))


@query("""WITH q AS (SELECT p_partkey AS id, p_brand AS topic, (p_size % 3)::INT AS difficulty, p_partkey % 4 = 0 AS cited FROM part WHERE p_partkey % 7 <> 0)
SELECT topic, id, difficulty, cited FROM q QUALIFY row_number() OVER (PARTITION BY topic ORDER BY (difficulty + 2) % 3, cited DESC, id) = 1""")
def o11_preferred_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each topic's questions one: of the level that is wanted first, then one on cited evidence, then the least id. Questions already asked are out."""
    rows = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_brand").alias("topic"), F.col("p_partkey").alias("id"), (F.col("p_size") % 3).cast("int").alias("difficulty"), (F.col("p_partkey") % 4 == 0).alias("cited"))
    best = F.min(F.struct((F.col("difficulty") + 2) % 3, F.when(F.col("cited"), 0).otherwise(1), "id", "difficulty", "cited"))
    return rows.groupBy("topic").agg(best.alias("b")).select("topic", "b.id", "b.difficulty", "b.cited")


@query("""WITH d AS (SELECT doc_id, md5('packet|' || doc_id) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS copy FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS place FROM d WHERE copy = 1)
SELECT doc_id, 'P' || lpad(place::VARCHAR, 6, '0') AS blind_id, CASE WHEN place <= 20 THEN 'calibration' ELSE 'audit' END AS packet FROM r WHERE place <= 60""")
def o10_blind_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples without a document or a text in common, under ids that tell nothing: a sampling operator."""
    docs = table(spark, sf_dir, "documents").where("text is not null").groupBy(F.md5(F.col("text").cast("binary")).alias("t")).agg(F.min("doc_id").alias("doc_id"))
    drawn = docs.select("doc_id", F.md5(F.concat(F.lit("packet|"), F.col("doc_id").cast("string")).cast("binary")).alias("h")).orderBy("h", "doc_id").limit(60)
    place = F.row_number().over(Window.orderBy("h", "doc_id"))
    return drawn.withColumn("place", place).select("doc_id", F.concat(F.lit("P"), F.lpad(F.col("place").cast("string"), 6, "0")).alias("blind_id"), F.when(F.col("place") <= 20, "calibration").otherwise("audit").alias("packet"))


_NOTE = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace({0}, '‐', '-'), '‑', '-'), '‘', ''''), '’', ''''), '“', '\"'), '”', '\"'), '\s+', ' ', 'g'))"


@query(rf"""WITH q AS (SELECT doc_id, text, array_to_string(list_slice(string_split(text, ' '), 3, 7), ' ') AS a, array_to_string(list_slice(string_split(text, ' '), 12, 16), ' ') AS b FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, {_NOTE.format('text')} AS s, {_NOTE.format('a')} AS a, {_NOTE.format('b')} AS b FROM q),
w AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN [b, a] WHEN doc_id % 5 = 0 THEN [a, 'words that nobody wrote'] ELSE [a, b] END AS f FROM n), g AS (SELECT *, list_filter(f, lambda x: x <> '') AS p FROM w),
k AS (SELECT doc_id, len(p) > 0 AND len(list_filter(p, lambda x: len(list_filter(string_split(x, ' '), lambda y: regexp_matches(y, '[\p{{L}}\p{{N}}]'))) < 3)) = 0 AS long_enough, s, p, strpos(s, p[1]) AS place FROM g)
SELECT doc_id, long_enough AND place > 0 AND (len(p) = 1 OR strpos(substr(s, place + length(p[1])), p[2]) > 0) AS grounded FROM k""")
def p21_p22_grounded_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether quotes with a gap stand in their document in order: two pieces of it, for some in the wrong order or made up."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    cut = lambda a, n: unicode.quote_key(F.array_join(F.slice(F.split("text", " ", -1), a, n), " "))
    rows = docs.select("doc_id", unicode.quote_key("text").alias("source"), cut(3, 5).alias("a"), cut(12, 5).alias("b"))
    k = F.col("doc_id")
    pieces = F.when(k % 3 == 0, F.array("b", "a")).when(k % 5 == 0, F.array(F.col("a"), F.lit("words that nobody wrote"))).otherwise(F.array("a", "b"))
    held = rows.select("doc_id", "source", F.filter(pieces, lambda x: x != "").alias("pieces"))
    return held.select("doc_id", merging.grounded(F.col("pieces"), F.col("source")).alias("grounded"))


@query("""WITH v AS (SELECT l_orderkey AS run_id, count(*) FILTER (WHERE l_quantity > 45) > 0 AS unsure, count(*) FILTER (WHERE l_discount >= 0.09) > 0 AS critical, count(*) FILTER (WHERE l_quantity < 5) > 0 AS contradicted, count(*) FILTER (WHERE l_quantity BETWEEN 20 AND 45) > 0 AS met,
count(*) FILTER (WHERE l_returnflag = 'A') > 0 AND count(*) FILTER (WHERE l_returnflag = 'A' AND NOT l_quantity BETWEEN 20 AND 45) = 0 OR count(*) FILTER (WHERE l_returnflag = 'R') > 0 AND count(*) FILTER (WHERE l_returnflag = 'R' AND NOT l_quantity BETWEEN 20 AND 45) = 0 AS required, count(*) FILTER (WHERE l_tax >= 0.08) > 0 AS minor FROM lineitem GROUP BY 1)
SELECT run_id, CASE WHEN unsure THEN NULL WHEN critical THEN 0 WHEN required AND NOT minor AND NOT contradicted THEN 2 WHEN met THEN 1 ELSE 0 END AS score FROM v""")
def p31_rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers' scores: none where a verdict is unsure, 0 for a critical error, 2 where all criteria of one needed path are met and nothing is wrong, else 1 for anything met."""
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    met = q.between(20, 45)
    path = lambda f: (F.count_if(flag == f) > 0) & (F.count_if((flag == f) & ~met) == 0)
    some = lambda c: F.count_if(c) > 0
    score = (
        F.when(some(q > 45), None)
        .when(some(F.col("l_discount") >= 0.09), 0)
        .when((path("A") | path("R")) & ~some(F.col("l_tax") >= 0.08) & ~some(q < 5), 2)
        .when(some(met), 1)
        .otherwise(0)
    )
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(score.alias("score"))


@query("""SELECT doc_id, 'sha256:' || sha256('{"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || coalesce(n_chars::VARCHAR, 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}' || chr(10)) AS canonical_hash FROM documents""")
def s13_canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of canonical JSON: names in order, no blanks, nulls written, a line end."""
    payload = F.to_json(F.struct("lang", "n_chars", "source"), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2(F.concat(payload, F.lit("\n")), 256)).alias("canonical_hash"))


@query("""WITH e AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS copy, event_id % 3 = 0 AS done FROM events) SELECT event_type, count(*) FILTER (WHERE copy = 1)::BIGINT AS appended, count(*) FILTER (WHERE copy > 1)::BIGINT AS repeated, count(*) FILTER (WHERE copy = 1 AND NOT done)::BIGINT AS still_to_do FROM e GROUP BY 1""")
def w5_w11_append_and_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that an idempotent append takes, those it has already, and what a resumed run has still to do."""
    copy = F.row_number().over(Window.partitionBy("user_id", "ts").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 3 == 0).alias("done"), copy.alias("copy"))
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.groupBy("event_type").agg(n(F.col("copy") == 1, "appended"), n(F.col("copy") > 1, "repeated"), n((F.col("copy") == 1) & ~F.col("done"), "still_to_do"))
