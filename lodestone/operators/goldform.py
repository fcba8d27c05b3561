"""Older gold questions in today's form: evidence gets the one textbook in which its words stand, and nothing else of it changes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import anchoring, finding

# Labels of splits, and those that a map may assign provisional ones to.
LABELS, SPLITS = ("pending", "proposed_test", "dev", "test"), ("dev", "test")
BOOKS = "chapter_id string, quote string, block string, book string"
BOOK_ROWS = pa.schema([(c, pa.string()) for c in ("chapter_id", "quote", "block", "book")])
#: Why evidence is refused, the first that holds.
UNANNOTATED, OFFSETS, BOOK = "no chapter or sufficiency", "another chapter offset", "no unique textbook"


def books_of(chunk: dict, hits: list[tuple[int, int]]) -> list[dict]:
    """A row for each quote in a chunk, and one for each with each of its blocks."""
    quotes = {chunk["text"][a : a + n] for a, n in hits}
    return [{"chapter_id": chunk["chapter_id"], "quote": q, "block": b, "book": chunk["textbook_id"]} for q in quotes for b in (None, *{b for b in chunk["blocks"] or () if b is not None})]


def mapped_split(split: Column, question: Column, mapping: dict[str, str]) -> Column:
    """A question's split by a map of labels, or, if the map names anything else, of every question."""
    if any(v not in SPLITS for v in mapping.values()):
        raise ValueError("a split is dev or test")
    labels = not set(mapping) - set(LABELS)
    if labels and any(k in SPLITS and k != v for k, v in mapping.items()):
        raise ValueError("dev and test stay as they are")
    if not mapping:
        return split
    known = F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair])
    to = F.try_element_at(known, split if labels else question)
    if labels:
        return F.coalesce(to, split)
    return F.coalesce(to, F.raise_error(F.concat(F.lit("GOLD: not in the map of splits: "), question)))


def converted(gold: DataFrame, chunks: DataFrame, corpus_version: str, *, splits: dict[str, str] | None = None, strict: bool = True) -> DataFrame:
    """(question_id, split, source_corpus_version, corpus_version, core, partial, refused) of gold in one of the two older forms.

    gold: question_id, split, corpus_version, source_corpus_version (null in the first form), core (arrays of evidence, one for each
    path) and partial (an array of evidence). Evidence: span_id, chapter_id, char_start, char_end, chapter_char_start,
    chapter_char_end, verbatim_text, block_id, sufficiency, annotation_note. chunks: textbook_id, chapter_id, chunk_id, text,
    blocks (ids).

    Evidence comes out with its textbook and its original offsets as those of the chapter. It needs a chapter, a sufficiency, chapter
    offsets that are its own or none, and words that stand in chunks of one textbook alone, in that chapter and in its block if it
    names one. refused lists why a question's evidence isn't so, sorted; strict, such a question makes the job fail instead.
    Repeated and null question ids fail always. Empty notes become null. Empty sets stay empty. No rows: none come out.
    """
    asked = gold.groupBy("question_id").agg(F.count("*").alias("__n"), F.first(F.struct(*[c for c in gold.columns if c != "question_id"])).alias("q"))
    twice = F.col("question_id").isNull() | (F.col("__n") > 1)
    say = F.concat(F.lit("GOLD: a question twice or without id: "), F.coalesce(F.col("question_id").cast("string"), F.lit("null")))
    rows = asked.where(F.when(twice, F.raise_error(say).cast("boolean")).otherwise(True)).select("question_id", "q.*")
    sets = F.concat(F.transform("core", lambda group, g: F.transform(group, lambda e, i: F.struct(g.alias("g"), i.alias("i"), e.alias("e")))), F.array(F.transform("partial", lambda e, i: F.struct(F.lit(-1).alias("g"), i.alias("i"), e.alias("e")))))
    each = rows.select("question_id", F.coalesce("source_corpus_version", "corpus_version").alias("origin"), F.explode(F.flatten(sets)).alias("x")).select("question_id", "origin", "x.g", "x.i", "x.e")
    own = chunks.where("textbook_id IS NOT NULL AND chapter_id IS NOT NULL AND text IS NOT NULL").select("chapter_id", "textbook_id", "text", "blocks")
    met = finding.read(own, finding.marked(each.where("e.chapter_id IS NOT NULL"), "e.verbatim_text"), books_of, BOOK_ROWS, BOOKS, anchoring.PART_CHARS, anchoring.PART_SPANS)
    books = met.groupBy("chapter_id", "quote", "block").agg(F.min("book").alias("low"), F.max("book").alias("high"))
    same = (F.col("e.chapter_id") == F.col("chapter_id")) & (F.col("e.verbatim_text") == F.col("quote")) & F.col("e.block_id").eqNullSafe(F.col("block"))
    other = lambda a, b: F.col(f"e.{a}").isNotNull() & ~F.col(f"e.{a}").eqNullSafe(F.col(f"e.{b}"))
    why = (
        F.when(F.col("e.chapter_id").isNull() | F.col("e.sufficiency").isNull(), UNANNOTATED)
        .when(other("chapter_char_start", "char_start") | other("chapter_char_end", "char_end"), OFFSETS)
        .when(F.col("low").isNull() | (F.col("low") != F.col("high")), BOOK)
    )
    span = F.struct("e.span_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("textbook_id"), "e.chapter_id", F.col("e.char_start").alias("chapter_char_start"), F.col("e.char_end").alias("chapter_char_end"), "e.verbatim_text", "e.block_id", F.col("origin").alias("origin_corpus_version"))
    new = F.struct(span.alias("span"), "e.sufficiency", F.when(F.col("e.annotation_note") != "", F.col("e.annotation_note")).alias("annotation_note"))
    made = each.join(books, same, "left").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("g", "i", new.alias("new")))).alias("made"), F.sort_array(F.collect_set(why)).alias("refused"))
    of = lambda g: F.transform(F.filter("made", lambda x: x["g"] == g), lambda x: x["new"])
    out = rows.join(made, "question_id", "left").withColumn("refused", F.coalesce("refused", F.array().cast("array<string>")))
    if strict:
        no = F.concat(F.lit("GOLD: "), F.col("question_id").cast("string"), F.lit(": "), F.array_join("refused", ", "))
        out = out.where(F.when(F.size("refused") > 0, F.raise_error(no).cast("boolean")).otherwise(True))
    core = F.transform("core", lambda _, g: F.coalesce(of(g), F.array()))
    split = mapped_split(F.col("split"), F.col("question_id").cast("string"), splits or {})
    return out.select("question_id", split.alias("split"), F.coalesce("source_corpus_version", "corpus_version").alias("source_corpus_version"), F.lit(corpus_version).alias("corpus_version"), core.alias("core"), F.coalesce(of(F.lit(-1)), F.array()).alias("partial"), "refused")
