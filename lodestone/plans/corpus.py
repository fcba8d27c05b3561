"""Queries over texts: normalisation, deduplication, spans, sampling."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as texts
from lodestone.functions import unicode
from lodestone.functions.text import collapsed, ruler_tokens, slug, word_count
from lodestone.operators.spans import cut, islands, line_spans, line_starts, without_adjacent_repeats
from lodestone.registry import query, table

NORM = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL)"""


@query(f"""WITH n AS (SELECT doc_id, source, 'sha256:' || sha256(nfc_normalize({NORM})) AS text_hash FROM documents WHERE length({NORM}) >= 40),
g AS (SELECT text_hash, count(DISTINCT source)::BIGINT AS n_sources FROM n GROUP BY 1 HAVING count(DISTINCT source) >= 2) SELECT text_hash, n_sources, source, doc_id FROM n JOIN g USING (text_hash)""")
def d1_cross_source_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of all groups of equal normalised texts that stand in two sources or more, a row each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", unicode.duplicate_key("text").alias("norm")).where(F.char_length("norm") >= 40)
    members = docs.select(F.concat(F.lit("sha256:"), F.sha2("norm", 256)).alias("text_hash"), "source", "doc_id")
    groups = members.groupBy("text_hash", "source").agg(F.lit(1).alias("one")).groupBy("text_hash").agg(F.count("source").alias("n_sources")).where("n_sources >= 2")
    return members.join(groups, "text_hash").select("text_hash", "n_sources", "source", "doc_id")


@query(f"SELECT min(doc_id) AS doc_id, sha256({NORM}) AS text_hash FROM documents WHERE text IS NOT NULL GROUP BY 2")
def d2_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(F.sha2(collapsed(F.col("text")), 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_hash")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, sha256(arg_max(text, turn)) AS text_hash FROM conversations GROUP BY conv_id")
def d3_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.sha2(F.max_by("text", "turn"), 256).alias("text_hash"))


@query(r"""WITH t AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS n FROM documents)
SELECT source, lang, count(*)::BIGINT AS docs, min(n)::BIGINT AS least, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, max(n)::BIGINT AS most, count(*) FILTER (WHERE n > 500)::BIGINT AS oversized FROM t GROUP BY ALL""")
def t3_c10_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "lang", F.size(ruler_tokens(F.col("text"))).alias("n"))
    return rows.groupBy("source", "lang").agg(F.count("*").alias("docs"), F.min("n").cast("long").alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", 0.5), 6).alias("median"), F.max("n").cast("long").alias("most"), F.count_if(F.col("n") > 500).alias("oversized"))


@query(r"SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')))::INT AS words FROM documents WHERE text IS NOT NULL")
def t8_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", word_count(F.col("text")).cast("int").alias("words"))


SLUG = r"coalesce(nullif(trim(regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '[^a-z0-9._-]+', '-', 'g'), '-'), ''), 'unknown')"


@query(f"SELECT p_partkey, {SLUG.format('p_name')} AS slug, {SLUG.format('p_brand')} || '__' || substr(sha256(p_brand || '|' || p_name || '|' || p_type || '|v1'), 1, 16) AS part_id FROM part")
def p8_p9_slugs_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = [F.col("p_brand"), F.col("p_name"), F.col("p_type"), F.lit("v1")]
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"), texts.named_digest(F.col("p_brand"), *identity).alias("part_id"))


@query(f"""SELECT l_orderkey, l_linenumber, {SLUG.format("'order ' || l_orderkey")} || '__' || {SLUG.format('l_returnflag')} || '__' || right(regexp_replace(md5(l_returnflag), '[^a-fA-F0-9]', '', 'g'), 8) || '__' || lpad(l_linenumber::VARCHAR, 5, '0') AS chunk_id,
'p' || l_linenumber || CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE '-' || (l_linenumber + 1) END AS page FROM lineitem""")
def p10_p11_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids and page labels of order lines, which stand for chunks of a document."""
    n = F.col("l_linenumber").cast("int")
    name = texts.chunk_name(F.concat(F.lit("order "), F.col("l_orderkey").cast("string")), F.col("l_returnflag"), F.md5(F.col("l_returnflag").cast("binary")), n)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", name.alias("chunk_id"), texts.page_label(n, n + F.when(F.col("l_suppkey") % 2 == 0, 0).otherwise(1)).alias("page"))


@query(f"""WITH {LINES}, o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM lines)
SELECT doc_id, line_no::INT AS line_no, s::BIGINT AS start_at, (s + length(line))::BIGINT AS end_at FROM o""")
def c13_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spans(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "line_no", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(f"""WITH {LINES}, o AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS last, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM lines)
SELECT doc_id, count(*)::BIGINT AS lines, count(*) FILTER (WHERE r = 1 OR line IS DISTINCT FROM last)::BIGINT AS kept FROM o GROUP BY doc_id""")
def c12_adjacent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = line_spans(table(spark, sf_dir, "documents"))
    kept = without_adjacent_repeats(spans, "doc", "line_no", "line").groupBy("doc").agg(F.count("*").alias("kept"))
    return spans.groupBy("doc").agg(F.count("*").alias("lines")).join(kept, "doc").select(F.col("doc").alias("doc_id"), "lines", "kept")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 AS b FROM events WHERE ts IS NOT NULL),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, island::BIGINT AS island, min(a) AS begins, max(b) - min(a) AS length, count(*)::BIGINT AS spans FROM n GROUP BY user_id, island""")
def g2_c15_interval_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of each user's one-hour spans after their events."""
    at = F.expr("unix_micros(cast(ts as timestamp))")
    spans = table(spark, sf_dir, "events").where("ts is not null").select("user_id", at.alias("start"), (at + 3_600_000_000).alias("end"))
    return islands(spans, "user_id").select("user_id", "island", F.col("start").alias("begins"), (F.col("end") - F.col("start")).alias("length"), "spans")


@query("""WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('seed' || chr(10) || doc_id::VARCHAR), doc_id) AS turn FROM documents)
SELECT doc_id, source, turn::INT AS turn, (row_number() OVER (ORDER BY turn, source))::INT AS place FROM d WHERE turn <= 3""")
def o1_o2_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each source in hash order, dealt round by round: a sampling operator."""
    key = F.md5(F.concat(F.lit("seed\n"), F.col("doc_id").cast("string")).cast("binary"))
    turn = F.row_number().over(Window.partitionBy("source").orderBy(key, "doc_id"))
    drawn = table(spark, sf_dir, "documents").select("doc_id", "source", turn.alias("turn")).where("turn <= 3")
    return drawn.withColumn("place", F.row_number().over(Window.orderBy("turn", "source")))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CASE WHEN url LIKE '%/blog/%' THEN 'blog' WHEN regexp_matches(html, '<table') THEN 'table' WHEN regexp_matches(html, '<pre|<code') THEN 'code' ELSE 'text' END AS kind FROM pages""")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("url").like("%/blog/%"), "blog").when(F.col("html").rlike("<table"), "table").when(F.col("html").rlike("<pre|<code"), "code").otherwise("text")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), kind.alias("kind"))


# The tables have no sections and record types of their own; these stand for them, by line and document.
RECORDS = f"""{LINES}, r AS (SELECT l.doc_id, line_no::INT AS line_no, line, lang, source, ['paragraph', 'heading', 'formula', 'table', 'figure', 'paragraph', 'paragraph'][((l.doc_id + line_no) % 7 + 1)::INT] AS kind,
['Glossary', 'Section  Summary', 'Conceptual Questions', 'Test Prep for AP Courses', 'Kinematics', 'Connection for AP Courses', 'Waves', 'Chapter Review'][((l.doc_id // 3 + line_no // 12) % 8 + 1)::INT] AS section, line_no // 36 AS chapter,
CASE WHEN line_no % 5 = 0 THEN 'Example ' || line WHEN line_no % 11 = 3 THEN 'Check Your Understanding ' || line WHEN line_no % 13 = 4 THEN 'Strategy' ELSE line END AS text FROM lines l JOIN documents USING (doc_id))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, chapter, kind, section, text): lines as a parser's records, with kinds and sections by their numbers."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    kind = pick(("paragraph", "heading", "formula", "table", "figure", "paragraph", "paragraph"), (F.col("doc_id") + F.col("line_no")) % 7)
    section = pick(("Glossary", "Section  Summary", "Conceptual Questions", "Test Prep for AP Courses", "Kinematics", "Connection for AP Courses", "Waves", "Chapter Review"), (F.floor(F.col("doc_id") / 3) + F.floor(F.col("line_no") / 12)) % 8)
    head = F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("Example "), "line")).when(F.col("line_no") % 11 == 3, F.concat(F.lit("Check Your Understanding "), "line")).when(F.col("line_no") % 13 == 4, "Strategy")
    return lines.select("doc_id", "line_no", F.floor(F.col("line_no") / 36).cast("int").alias("chapter"), kind.alias("kind"), section.alias("section"), head.otherwise(F.col("line")).alias("text"))


@query(rf"""WITH {RECORDS}, k AS (SELECT doc_id, line_no, kind, section, text, trim(regexp_replace(lower(section), '\s+', ' ', 'g')) AS title, lower(trim(text)) AS body, replace(lower(section), 'ß', 'ss') AS raw FROM r)
SELECT doc_id, line_no, title IN ('section summary', 'conceptual questions', 'problems & exercises', 'problems and exercises', 'chapter review') OR title LIKE 'test prep%' AS excluded,
regexp_full_match(trim(text), '(?i)(strategy|solution|discussion)\b[^\n]{{0,20}}') AS inline_heading,
CASE WHEN kind = 'formula' THEN 'equation' WHEN kind = 'table' THEN 'table' WHEN kind IN ('figure', 'figure_caption') THEN 'figure_caption' WHEN raw IN ('glossary', 'key terms') THEN 'glossary' WHEN raw = 'section summary' THEN 'summary'
WHEN raw = 'conceptual questions' THEN 'conceptual_question' WHEN raw IN ('problems & exercises', 'problems and exercises', 'chapter review') OR raw LIKE 'test prep%' THEN 'problem' WHEN contains(raw, 'connection for ap') AND kind <> 'heading' THEN 'sidebar'
WHEN body LIKE 'example %' OR body LIKE 'worked example%' THEN 'example' WHEN body LIKE 'check your understanding%' THEN 'check_understanding' WHEN contains(body, 'learning objectives') OR body LIKE 'by the end of this section%' THEN 'learning_objective'
WHEN body LIKE 'phet explorations%' OR body LIKE 'career connection%' OR body LIKE 'real world connections%' OR body LIKE 'making connections%' OR body LIKE 'take-home investigation%' THEN 'sidebar' WHEN kind = 'heading' THEN 'heading' ELSE 'body' END AS content_type FROM k""")
def p2_p3_p5_record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of records by the first rule that holds, and which stand in sections that are left out or are headings inside an example."""
    text, section = F.col("text"), F.col("section")
    return records(spark, sf_dir).select("doc_id", "line_no", texts.excluded_section(section).alias("excluded"), texts.inline_heading(text).alias("inline_heading"), texts.record_type(F.col("kind"), section, text).alias("content_type"))


@query(rf"""WITH {RECORDS} SELECT doc_id, count(*) FILTER (WHERE kind IN ('table', 'figure'))::BIGINT AS evidence, count(*) FILTER (WHERE regexp_full_match(text, '|[0-9]+\s*[•|]\s*.+|.+\s*[•|]\s*[0-9]+'))::BIGINT AS dropped FROM r GROUP BY 1""")
def p1_p4_evidence_and_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose kind is evidence, and running headers and footers, by document."""
    kind = F.when(F.col("kind") == "figure", "figure_caption").otherwise(F.col("kind"))
    return records(spark, sf_dir).groupBy("doc_id").agg(F.count_if(kind.isin(*texts.EVIDENCE_TYPES)).alias("evidence"), F.count_if(texts.running_header(F.col("text"))).alias("dropped"))


@query(r"""WITH t AS (SELECT p_partkey, (p_size % 9)::VARCHAR AS chapter, CASE WHEN p_partkey % 3 = 0 THEN (p_size % 9) || '.' || p_size || ' ' || p_name WHEN p_partkey % 7 = 0 THEN 'Introduction to ' || p_name ELSE p_name END AS title FROM part)
SELECT p_partkey, chapter || '.' || CASE WHEN p_partkey % 3 = 0 THEN regexp_extract(title, '\.([0-9]+)', 1) WHEN p_partkey % 7 = 0 THEN 'introduction' ELSE trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') END AS section_id,
CASE WHEN p_partkey % 3 = 0 THEN trim(regexp_replace(title, '^[0-9]+\.[0-9]+\s+', '')) ELSE title END AS title FROM t""")
def p7_section_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section ids of part names, some of them numbered as headings of a chapter."""
    chapter = (F.col("p_size") % 9).cast("string")
    numbered = F.concat(chapter, F.lit("."), F.col("p_size").cast("string"), F.lit(" "), "p_name")
    title = F.when(F.col("p_partkey") % 3 == 0, numbered).when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("Introduction to "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", texts.chapter_section(chapter, title).alias("s")).select("p_partkey", "s.*")


@query(rf"""WITH {LINES}, o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM lines)
SELECT doc_id, o.line_no::INT AS line_no, substr(text, s::INT + 1, length(line)) AS slice, substr(line, 1, 20) || CASE WHEN length(line) > 20 THEN '...' ELSE '' END AS preview FROM o JOIN documents USING (doc_id)""")
def p6_p41_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line cut from its text by its span, and its beginning. Spans and slices are made inside the text's row, in linear time."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", line_starts("text").alias("starts"))
    ends = F.transform("starts", lambda x, i: F.coalesce(F.get("starts", i + 1) - 1, F.char_length("text")))
    rows = docs.select("doc_id", F.posexplode(cut("text", "starts", ends)).alias("line_no", "slice"))
    return rows.select("doc_id", "line_no", "slice", F.concat(F.substring("slice", 1, 20), F.when(F.char_length("slice") > 20, "...").otherwise("")).alias("preview"))


@query(r"""WITH p AS (SELECT page_id, 'source=' || replace(url_encode(url), '+', '%20') || '|textbook=' || replace(url_encode(coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '')), '+', '%20') || '|chapter=' || (page_id % 12) || '|location=|span=0:' || length(html) AS locator FROM pages WHERE html IS NOT NULL)
SELECT page_id, locator, regexp_full_match(locator, 'source=[^|]*\|textbook=[^|]*\|chapter=[^|]*\|location=[^|]*\|span=[0-9]+:[0-9]+') AS valid FROM p""")
def p12_p13_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where("html is not null")
    where = texts.locator(F.col("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1), (F.col("page_id") % 12).cast("string"), F.lit(None).cast("string"), F.lit(0), F.char_length("html"))
    return pages.select("page_id", where.alias("locator")).withColumn("valid", texts.is_locator(F.col("locator")))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '\r\n?', chr(10), 'g'), '([\p{L}\p{N}_])-\s*\n\s*([a-z])', '\1\2', 'g'), '\s*\n\s*', ' ', 'g'), '[\t ]+', ' ', 'g'))) AS prose FROM documents WHERE text IS NOT NULL")
def p14_p15_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in compatibility composition as one line; the given texts have no compatibility characters, so SQL leaves that out."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", unicode.nfkc("text").alias("text"))
    return docs.select("doc_id", F.sha2(texts.rejoined_prose(F.col("text")), 256).alias("prose"))


@query(r"""SELECT p_partkey, (p_size || '.' || p_size % 7 || ' and ' || p_partkey || '.5 of ' || p_name) AS plain FROM part""")
def p16_spoken_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are spelled with point or period, made of parts' sizes."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    spoken = F.concat(size, F.lit(" point "), (F.col("p_size") % 7).cast("string"), F.lit(" and "), key, F.lit("  Period 5 of "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", texts.spoken_decimals(spoken).alias("plain"))


@query(r"""WITH t AS (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN 'Chapter 3.' || p_size || '  ' WHEN 1 THEN '12.4-12.7: ' WHEN 2 THEN '“' ELSE '' END || upper(p_name) AS title FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN '"' ELSE '' END || lower(p_name) AS alias, trim(regexp_replace(replace(lower(title), '“', '"'), '\s+', ' ', 'g')) AS title FROM t""")
def p19_p20_title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of part names as titles, some with numbers or quotes in front."""
    k = F.col("p_partkey") % 4
    front = F.when(k == 0, F.concat(F.lit("Chapter 3."), F.col("p_size").cast("string"), F.lit("  "))).when(k == 1, "12.4-12.7: ").when(k == 2, "“").otherwise("")
    title = F.concat(front, F.upper("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", texts.alias_key(title).alias("alias"), texts.title_key(title).alias("title"))


@query(r"""WITH k AS (SELECT p_partkey, p_type || ' ' || p_size || '.' || p_partkey AS name FROM part)
SELECT p_partkey, (row_number() OVER (ORDER BY lower(regexp_extract(name, '^[^0-9]+', 0)), regexp_extract(name, '([0-9]+)\.', 1)::INT, p_partkey))::INT AS place FROM k""")
def o8_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of names in an order that takes numbers by their value. Places come from counts of ranges, not from one sorted task."""
    from lodestone.operators.ranking import placed

    name = F.concat_ws("", "p_type", F.lit(" "), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    return placed(table(spark, sf_dir, "part").select("p_partkey", texts.natural_key(name).alias("key")), "key").select("p_partkey", F.col("place").cast("int").alias("place"))
