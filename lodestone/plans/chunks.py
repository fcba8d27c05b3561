"""Queries of chunks and spans: segments, chunks of a wanted size, parents, coverage of gold spans and where they stand."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as texts
from lodestone.operators import chunking, joins, quoting
from lodestone.plans.corpus import RECORDS, records
from lodestone.registry import query, table

_K = """k AS (SELECT doc_id, line_no, chapter, kind, section, text, trim(regexp_replace(lower(section), '\\s+', ' ', 'g')) AS title, lower(trim(text)) AS body, lower(section) AS raw FROM r),
t AS (SELECT doc_id, line_no, chapter, section, text, title IN ('section summary', 'conceptual questions', 'problems & exercises', 'problems and exercises', 'chapter review') OR title LIKE 'test prep%' AS excluded, regexp_full_match(trim(text), '(?i)(strategy|solution|discussion)\\b[^\\n]{0,20}') AS short,
CASE WHEN kind = 'formula' THEN 'equation' WHEN kind = 'table' THEN 'table' WHEN kind = 'figure' THEN 'figure_caption' WHEN raw IN ('glossary', 'key terms') THEN 'glossary' WHEN raw = 'section summary' THEN 'summary' WHEN raw = 'conceptual questions' THEN 'conceptual_question'
WHEN raw IN ('problems & exercises', 'problems and exercises', 'chapter review') OR raw LIKE 'test prep%' THEN 'problem' WHEN contains(raw, 'connection for ap') AND kind <> 'heading' THEN 'sidebar' WHEN body LIKE 'example %' OR body LIKE 'worked example%' THEN 'example' WHEN body LIKE 'check your understanding%' THEN 'check_understanding'
WHEN contains(body, 'learning objectives') OR body LIKE 'by the end of this section%' THEN 'learning_objective' WHEN body LIKE 'phet explorations%' OR body LIKE 'career connection%' OR body LIKE 'real world connections%' OR body LIKE 'making connections%' OR body LIKE 'take-home investigation%' THEN 'sidebar' WHEN kind = 'heading' THEN 'heading' ELSE 'body' END AS ct FROM k)"""
SEGMENTS = RECORDS + ", " + _K + r""",
p AS (SELECT *, short AND ct = 'heading' AS inline_heading, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, coalesce((chapter, section) IS DISTINCT FROM lag((chapter, section)) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS changed FROM t),
q AS (SELECT *, changed OR ct IN ('glossary', 'example') OR (ct = 'heading' AND NOT inline_heading) AS ends FROM p),
u AS (SELECT *, coalesce(last_value(CASE WHEN excluded THEN 'reset' WHEN ct = 'check_understanding' THEN 'open' WHEN ends THEN 'end' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'end') AS last FROM q),
v AS (SELECT *, NOT excluded AND NOT (last = 'open' AND NOT ends) AND ct <> 'check_understanding' AND (ct IN ('body', 'example', 'figure_caption', 'glossary', 'table', 'equation') OR inline_heading) AS kept FROM u),
w AS (SELECT *, kept AND (NOT coalesce(lag(kept) OVER (PARTITION BY doc_id ORDER BY line_no), false) OR changed) AS new FROM v),
x AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS segment FROM w),
seg AS (SELECT doc_id, line_no, segment::BIGINT AS segment, chapter, section, ct AS content_type, inline_heading, text, s::BIGINT AS s, (s + length(text))::BIGINT AS e FROM x WHERE kept)"""


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their type, span, and whether they are excluded or headings inside an example."""
    text = F.col("text")
    rows = records(spark, sf_dir)
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    kind = texts.record_type(F.col("kind"), F.col("section"), text)
    rows = rows.withColumn("content_type", kind).withColumn("excluded", texts.excluded_section(F.col("section"))).withColumn("inline_heading", texts.inline_heading(text) & (F.col("content_type") == "heading"))
    return rows.withColumn("start", F.coalesce(F.sum(F.char_length("text") + 1).over(before), F.lit(0))).withColumn("end", F.col("start") + F.char_length("text"))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.segments(typed(spark, sf_dir))


@query(f"WITH {SEGMENTS} SELECT doc_id, line_no, segment, content_type, s AS start_at, e AS end_at FROM seg")
def c1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are evidence, by segment: exercises, summaries and excluded sections are out and end a segment."""
    return segmented(spark, sf_dir).select("doc_id", "line_no", "segment", "content_type", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query()
def c2_c5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of about 120 tokens, 160 at most, of whole records of one segment: id, spans, tokens, text hash and flags."""
    rows = segmented(spark, sf_dir).withColumn("n_tokens", F.size(texts.ruler_tokens(F.col("text"))))
    chunks = chunking.grouped(rows, target=120, most=160, least=40)
    held = rows.join(chunks.select("doc_id", "line_no", "chunk"), ["doc_id", "line_no"])
    lines = F.array_sort(F.collect_list(F.struct("line_no", "text", "content_type")))
    out = held.groupBy("doc_id", "chunk").agg(F.min("chapter").alias("chapter"), F.min("section").alias("section"), F.min("start").alias("start_at"), F.max("end").alias("end_at"), F.sum("n_tokens").alias("n_tokens"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), lines.alias("lines"))
    name = texts.chunk_name(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("chapter").cast("string"), F.sha2(F.lit("120|160|40"), 256), F.col("chunk"))
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["content_type"]))), ",")
    return out.select("doc_id", name.alias("chunk_id"), "chunk", "section", "first_line", "last_line", "start_at", "end_at", "n_tokens", F.sha2(text, 256).alias("text_hash"), kinds.alias("types"), (F.col("n_tokens") > 160).alias("oversized"), (F.col("n_tokens") < 40).alias("short"))


@query(f"WITH {SEGMENTS} SELECT doc_id, line_no, s AS start_at, e AS end_at, min(s) OVER (PARTITION BY doc_id, chapter, section) AS parent_start, max(e) OVER (PARTITION BY doc_id, chapter, section) AS parent_end FROM (SELECT doc_id, line_no, chapter, section, s::BIGINT AS s, (s + length(text))::BIGINT AS e FROM p)")
def c6_p37_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with the span of its section in the chapter."""
    return chunking.parents(typed(spark, sf_dir)).select("doc_id", "line_no", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "parent_start", "parent_end")


@query(f"""WITH {SEGMENTS}, b AS (SELECT doc_id, line_no, sha256(text) AS text_hash FROM seg WHERE length(trim(text)) > 0) SELECT text_hash, count(*)::BIGINT AS copies, count(DISTINCT doc_id)::BIGINT AS docs FROM b GROUP BY 1 HAVING count(*) > 1""")
def c7_repeated_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one-record chunks that come more than once: what a strict build refuses."""
    rows = segmented(spark, sf_dir).where(F.char_length(F.trim("text")) > 0)
    return rows.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("copies"), F.countDistinct("doc_id").alias("docs")).where("copies > 1")


@query(f"""WITH {SEGMENTS} SELECT doc_id, 'doc-' || doc_id || '__' || chapter || '__' || right(sha256('block'), 8) || '__' || lpad((line_no + 1)::VARCHAR, 5, '0') AS chunk_id, 'From doc ' || doc_id || ', chapter ' || chapter || ', section ' || section || ':' || chr(10) || chr(10) || text AS embed_text,
'p' || (chapter + 1) || CASE WHEN line_no % 36 > 30 THEN '-' || (chapter + 2) ELSE '' END AS location FROM seg WHERE length(trim(text)) > 0""")
def c8_p38_p39_block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each record: id, the text that is embedded, and its page."""
    doc, chapter = F.col("doc_id").cast("string"), F.col("chapter").cast("string")
    name = texts.chunk_name(F.concat(F.lit("doc "), doc), chapter, F.sha2(F.lit("block"), 256), F.col("line_no") + 1)
    told = F.concat(F.lit("From doc "), doc, F.lit(", chapter "), chapter, F.lit(", section "), "section", F.lit(":\n\n"), "text")
    page = F.col("chapter") + 1
    rows = segmented(spark, sf_dir).where(F.char_length(F.trim("text")) > 0)
    return rows.select("doc_id", name.alias("chunk_id"), told.alias("embed_text"), texts.page_label(page, page + F.when(F.col("line_no") % 36 > 30, 1).otherwise(0)).alias("location"))


@query(rf"""WITH {SEGMENTS} SELECT source, section, count(*)::BIGINT AS blocks, count(DISTINCT seg.doc_id)::BIGINT AS docs, sum(len(regexp_extract_all(seg.text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')))::BIGINT AS tokens, min(seg.doc_id) AS first_doc FROM seg JOIN documents USING (doc_id) GROUP BY ALL""")
def c14_section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, documents and tokens of each section by source."""
    rows = segmented(spark, sf_dir).select("doc_id", "section", F.size(texts.ruler_tokens(F.col("text"))).alias("n"))
    sums = rows.groupBy("doc_id", "section").agg(F.count("*").alias("blocks"), F.sum("n").alias("tokens"))  # before the join with what each document's source is
    met = sums.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return met.groupBy("source", "section").agg(F.sum("blocks").alias("blocks"), F.countDistinct("doc_id").alias("docs"), F.sum("tokens").alias("tokens"), F.min("doc_id").alias("first_doc"))


GOLD_SPANS = "g AS (SELECT doc_id, k::BIGINT AS k, k * 300 + 17 AS a, least(k * 300 + 217, length(text)) AS b, text AS whole FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 17 + 299) // 300)) AS k FROM documents WHERE length(text) > 17))"
_SPAN_TEXT = "joined AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS whole FROM r GROUP BY doc_id), g AS (SELECT doc_id, k::BIGINT AS k, k * 300 + 17 AS a, least(k * 300 + 217, length(whole)) AS b, whole FROM (SELECT doc_id, whole, unnest(range(0, (length(whole) - 17 + 299) // 300)) AS k FROM joined WHERE length(whole) > 17))"


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, whole): the documents that the records make."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return records(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("whole"))


def gold_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, k, a, b, said): 200 characters of every 300, cut out inside the document's row so that no span carries its text along."""
    pieces = F.regexp_extract_all("whole", F.lit(r"(?s).{1,300}"), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(pieces).alias("k", "piece")).select("doc_id", "k", F.substring("piece", 18, 200).alias("said")).where("said <> ''")
    return rows.withColumn("a", F.col("k") * 300 + 17).withColumn("b", F.col("a") + F.char_length("said"))


@query(rf"""WITH {SEGMENTS}, {_SPAN_TEXT}, c AS (SELECT doc_id, segment, min(s) AS s, max(e) AS e FROM seg GROUP BY ALL),
o AS (SELECT g.doc_id, k, greatest(a, s) AS x, least(b, e) AS y, whole, s <= a AND e >= b AS holds FROM g JOIN c ON c.doc_id = g.doc_id AND s < b AND a < e),
m AS (SELECT doc_id, k, count(*) AS n, max(holds) AS whole_in_one, sum(length(regexp_replace(substr(whole, x::INT + 1, (y - x)::INT), '\s', '', 'g'))) AS covered FROM o GROUP BY ALL),
z AS (SELECT g.doc_id, g.k, length(regexp_replace(substr(whole, a::INT + 1, (b - a)::INT), '\s', '', 'g')) AS total, coalesce(covered, 0) AS covered, coalesce(n, 0) AS n, coalesce(whole_in_one, false) AS whole_in_one FROM g LEFT JOIN m ON m.doc_id = g.doc_id AND m.k = g.k)
SELECT doc_id, k, n::BIGINT AS chunks, whole_in_one, round(covered / nullif(total, 0), 8) AS ratio, CASE WHEN covered = 0 THEN 'none' WHEN covered = total THEN 'full' ELSE 'partial' END AS status FROM z""")
def g3_gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far segments cover gold spans, in characters that aren't white space: full, partial or none."""
    return coverage(spark, sf_dir).select("doc_id", F.col("k").cast("long").alias("k"), "chunks", "whole_in_one", F.round(F.try_divide("covered", "total"), 8).alias("ratio"), "status")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = whole_texts(spark, sf_dir)
    spans = segmented(spark, sf_dir).groupBy("doc_id", "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    wanted = gold_spans(docs)
    met = joins.overlapping(spans, wanted.select("doc_id", "k", F.col("a").alias("other_start"), F.col("b").alias("other_end"), "said"), ["doc_id"], 512)
    x, y = F.greatest("start", "other_start"), F.least("end", "other_end")
    held = (F.col("start") <= F.col("other_start")) & (F.col("end") >= F.col("other_end"))
    own = F.substring("said", (x - F.col("other_start") + 1).cast("int"), (y - x).cast("int"))
    parts = met.select("doc_id", "k", held.alias("holds"), chunking.substantive(own).alias("n"))
    sums = parts.groupBy("doc_id", "k").agg(F.count("*").alias("chunks"), F.max("holds").alias("whole_in_one"), F.sum("n").alias("covered"))
    total = chunking.substantive(F.col("said"))
    rows = wanted.select("doc_id", "k", total.alias("total")).join(sums, ["doc_id", "k"], "left")
    rows = rows.select("doc_id", "k", "total", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("whole_in_one", F.lit(False)).alias("whole_in_one"), F.coalesce("covered", F.lit(0)).alias("covered"))
    return rows.withColumn("status", F.when(F.col("covered") == 0, "none").when(F.col("covered") == F.col("total"), "full").otherwise("partial"))


@query(rf"""WITH {SEGMENTS}, {_SPAN_TEXT}, c AS (SELECT doc_id, segment, min(s) AS s, max(e) AS e FROM seg GROUP BY ALL), o AS (SELECT g.doc_id, k, greatest(a, s) AS x, least(b, e) AS y, whole FROM g JOIN c ON c.doc_id = g.doc_id AND s < b AND a < e),
m AS (SELECT doc_id, k, sum(length(regexp_replace(substr(whole, x::INT + 1, (y - x)::INT), '\s', '', 'g'))) AS covered FROM o GROUP BY ALL), z AS (SELECT g.doc_id, coalesce(covered, 0) AS covered, length(regexp_replace(substr(whole, a::INT + 1, (b - a)::INT), '\s', '', 'g')) AS total FROM g LEFT JOIN m ON m.doc_id = g.doc_id AND m.k = g.k)
SELECT doc_id, count(*)::BIGINT AS spans, count(*) FILTER (WHERE covered = total AND covered > 0)::BIGINT AS usable, count(*) FILTER (WHERE covered > 0 AND covered < total)::BIGINT AS partial, count(*) FILTER (WHERE covered = 0)::BIGINT AS uncovered FROM z GROUP BY 1""")
def g5_g9_mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold spans of each document by coverage; those covered in full are the ones that a mapping takes. The counts add up."""
    is_ = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return coverage(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("spans"), is_("full", "usable"), is_("partial", "partial"), is_("none", "uncovered"))


@query(f"""WITH {GOLD_SPANS}, c AS (SELECT doc_id + CASE WHEN k % 7 = 5 THEN 100000000 ELSE 0 END AS doc_id, k, a + CASE k % 4 WHEN 1 THEN 3 WHEN 2 THEN 1000000 ELSE 0 END AS a, CASE WHEN k % 5 = 3 THEN 'not there' ELSE substr(whole, a::INT + 1, CASE WHEN k % 3 = 0 THEN 4 ELSE (b - a)::INT END) END AS said, doc_id AS own FROM g),
f AS (SELECT c.*, d.text, CASE WHEN d.text IS NOT NULL THEN (length(d.text) - length(replace(d.text, said, ''))) // nullif(length(said), 0) END AS found FROM c LEFT JOIN documents d ON d.doc_id = c.doc_id)
SELECT own AS doc_id, k, CASE WHEN text IS NULL THEN 'unknown_document' WHEN said = '' THEN 'empty' WHEN a + length(said) <= length(text) AND substr(text, a::INT + 1, length(said)) = said THEN 'exact' WHEN found = 1 THEN 'relocated' WHEN found > 1 THEN 'ambiguous' ELSE 'stale' END AS status,
CASE WHEN text IS NULL OR said = '' THEN NULL WHEN a + length(said) <= length(text) AND substr(text, a::INT + 1, length(said)) = said THEN a WHEN found = 1 THEN strpos(text, said) - 1 END::BIGINT AS resolved FROM f""")
def g7_j8_resolved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where quoted spans stand: where they say, at the one other place of their words, at several, or nowhere. Some are made wrong."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"))
    k = F.col("k")
    cut = F.when(k % 3 == 0, F.substring("said", 1, 4)).otherwise(F.col("said"))
    said = F.when(k % 5 == 3, "not there").otherwise(cut)
    a = F.col("a") + F.when(k % 4 == 1, 3).when(k % 4 == 2, 1000000).otherwise(0)
    claims = gold_spans(docs).select(F.struct(F.col("doc_id").alias("own"), "k").alias("claim"), (F.col("doc_id") + F.when(k % 7 == 5, 100000000).otherwise(0)).alias("doc_id"), a.alias("at"), said.alias("quote"))
    met = quoting.claimed_places(docs.where("whole is not null").select("doc_id", F.col("whole").alias("text")), claims)
    found = F.col("found")
    status = F.when(~F.col("known"), "unknown_document").when(F.col("quote") == "", "empty").when(F.col("there"), "exact").when(found == 1, "relocated").when(found > 1, "ambiguous").otherwise("stale")
    place = F.when(status == "exact", F.col("at")).when(status == "relocated", F.col("first"))
    return met.select("claim.own", "claim.k", status.alias("status"), place.cast("long").alias("resolved")).select(F.col("own").alias("doc_id"), F.col("k").cast("long").alias("k"), "status", "resolved")


@query(rf"""WITH {RECORDS}, n AS (SELECT doc_id, line_no, source, line, md5(trim(regexp_replace(lower(line), '\s+', ' ', 'g'))) AS h FROM r WHERE length(trim(line)) >= 20),
c AS (SELECT h FROM n GROUP BY 1 HAVING count(DISTINCT source) > 1), x AS (SELECT DISTINCT h FROM n WHERE doc_id % 10 = 0)
SELECT n.doc_id, n.line_no, CASE WHEN n.doc_id % 10 = 0 AND n.line_no % 3 = 0 THEN 'overlap' WHEN x.h IS NOT NULL THEN 'same_text' WHEN c.h IS NOT NULL THEN 'cross_source_copy' ELSE 'clear' END AS gate FROM n LEFT JOIN c ON c.h = n.h LEFT JOIN x ON x.h = n.h""")
def g11_j7_leakage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that may not be asked about: they stand in evidence, have its words, or are copied from source to source.

    Lines of documents with ids divisible by 10 stand for evidence. Overlap and equal words are two joins on keys, not one on either.
    """
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.char_length(F.trim("line")) >= 20)
    keyed = lines.select("doc_id", "line_no", "source", F.md5(F.trim(F.regexp_replace(F.lower("line"), r"\s+", " ")).cast("binary")).alias("h"))
    marks = keyed.groupBy("h").agg((F.min("source") != F.max("source")).alias("copied"), F.bool_or(F.col("doc_id") % 10 == 0).alias("evidence"))
    gate = F.when((F.col("doc_id") % 10 == 0) & (F.col("line_no") % 3 == 0), "overlap").when(F.col("evidence"), "same_text").when(F.col("copied"), "cross_source_copy").otherwise("clear")
    return keyed.join(marks, "h").select("doc_id", "line_no", gate.alias("gate"))


@query(rf"""WITH {SEGMENTS}, b AS (SELECT source, seg.doc_id, chapter, sha256(seg.text) AS h, length(trim(seg.text)) = 0 AS empty, len(regexp_extract_all(seg.text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS n FROM seg JOIN documents USING (doc_id)),
d AS (SELECT source, h, count(*) AS c FROM b GROUP BY ALL), rep AS (SELECT source, sum(c - 1)::BIGINT AS repeated FROM d GROUP BY 1)
SELECT source, count(*)::BIGINT AS chunks, count(*) FILTER (WHERE empty)::BIGINT AS empties, any_value(repeated) AS repeated, count(*) FILTER (WHERE n < 5)::BIGINT AS short, count(*) FILTER (WHERE n > 100)::BIGINT AS oversized, min(n)::BIGINT AS least, round(avg(n), 8) AS mean, round(quantile_cont(n, 0.5), 8) AS median, max(n)::BIGINT AS most, count(DISTINCT chapter)::BIGINT AS chapters FROM b JOIN rep USING (source) GROUP BY 1""")
def c10_chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each source as chunks: how many are empty, repeated, short or too large, and their tokens. Medians come from counts of sizes."""
    rows = segmented(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    sized = rows.select("source", "chapter", F.sha2("text", 256).alias("h"), (F.char_length(F.trim("text")) == 0).alias("empty"), F.size(texts.ruler_tokens(F.col("text"))).alias("n"))
    copies = sized.groupBy("source", "h").agg(F.count("*").alias("c")).groupBy("source").agg(F.sum(F.col("c") - 1).alias("repeated"))
    sums = sized.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if("empty").alias("empties"), F.count_if(F.col("n") < 5).alias("short"), F.count_if(F.col("n") > 100).alias("oversized"), F.min("n").cast("long").alias("least"), F.round(F.avg("n"), 8).alias("mean"), F.max("n").cast("long").alias("most"), F.countDistinct("chapter").alias("chapters"), F.round(F.percentile("n", 0.5), 8).alias("median"))
    return sums.join(copies, "source")
