"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a search query drops.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were",
    "what", "when", "where", "which", "who", "why", "will", "with",
)


def folded(text: Column) -> Column:
    """Lower case, with the sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def search_terms(text: Column) -> Column:
    """Terms for search: runs of a-z and 0-9 of the folded text."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(text: Column) -> Column:
    """Terms of a query: search terms without stop words."""
    return F.filter(search_terms(text), lambda t: ~t.isin(*STOP_WORDS))


def ruler_tokens(text: Column) -> Column:
    """Runs of Unicode word characters, and single other visible characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def collapsed(text: Column) -> Column:
    """The duplicate key of a text: folded, white space as single blanks, trimmed."""
    return F.trim(F.regexp_replace(folded(text), r"[ \t\n\x0B\f\r]+", " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def slug(text: Column) -> Column:
    """Lower case, with runs of all but a-z, 0-9, dot, underscore and hyphen as one hyphen; unknown for nothing."""
    found = F.trim(F.regexp_replace(F.lower(stripped(text)), "[^a-z0-9._-]+", "-"), F.lit("-"))
    return F.when(found == "", "unknown").otherwise(found)


def named_digest(name: Column, *identity: Column) -> Column:
    """A slug with 16 digits of the SHA-256 of all parts of an identity."""
    return F.concat(slug(name), F.lit("__"), F.substring(F.sha2(F.concat_ws("|", *identity), 256), 1, 16))


def page_label(first: Column, last: Column) -> Column:
    """p3 or p3-4."""
    return F.concat(F.lit("p"), first.cast("string"), F.when(last == first, "").otherwise(F.concat(F.lit("-"), last.cast("string"))))


def chunk_name(document: Column, chapter: Column, config_hash: Column, ordinal: Column) -> Column:
    """Slugs of document and chapter, the last 8 hex digits of a hash, and a number of five digits."""
    digits = F.regexp_replace(config_hash, "[^a-fA-F0-9]", "")
    fragment = F.when(digits == "", "config").otherwise(F.substring(digits, F.greatest(F.length(digits) - 7, F.lit(1)), F.lit(8)))
    return F.concat_ws("__", slug(document), slug(chapter), fragment, F.format_string("%05d", ordinal))


def locator(source: Column, book: Column, chapter: Column, location: Column, start: Column, end: Column) -> Column:
    """source=...|textbook=...|chapter=...|location=...|span=a:b with all values percent-encoded; null as nothing."""
    value = lambda c: percent_encoded(F.coalesce(c, F.lit("")))
    parts = [F.concat(F.lit(f"{k}="), value(c)) for k, c in (("source", source), ("textbook", book), ("chapter", chapter), ("location", location))]
    return F.concat_ws("|", *parts, F.concat(F.lit("span="), start.cast("string"), F.lit(":"), end.cast("string")))


def is_locator(text: Column) -> Column:
    return text.rlike(r"^source=[^|]*\|textbook=[^|]*\|chapter=[^|]*\|location=[^|]*\|span=[0-9]+:[0-9]+$")


def word_count(text: Column) -> Column:
    """Words between white space, 1 at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")))


def long_words(text: Column) -> Column:
    """The set of a-z and 0-9 words of four characters or more, in lower case."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 4))


def percent_encoded(text: Column) -> Column:
    """Percent-encoding of all but letters, digits and _.-~"""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def rejoined_prose(text: Column) -> Column:
    """Text as one line: words cut at a line's end are joined again, blanks around line breaks go, white space is single blanks.

    Soft hyphens go. Compatibility characters stay as they are; see functions.unicode.nfkc. Each line looks at the next one
    alone: it loses the hyphen that cuts a word before a small letter, or gets a blank behind it.
    """
    lines = F.split(F.replace(F.replace(text, F.lit("\u00ad"), F.lit("")), F.lit("\r"), F.lit("\n")), r"\s*\n\s*", -1)

    def ended(all_lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            cut = line.rlike(r"(?U)\w-$") & F.coalesce(F.get(all_lines, i + 1).rlike("^[a-z]"), F.lit(False))
            return F.when(cut, F.substring(line, F.lit(1), F.char_length(line) - 1)).otherwise(F.concat(line, F.lit(" ")))

        return F.array_join(F.transform(all_lines, one), "")

    joined = F.transform(F.array(lines), ended)[0]  # the lines are split once, not anew for each
    return F.when(text.isNotNull(), stripped(F.regexp_replace(joined, "[\t ]+", " ")))


def spoken_decimals(text: Column, passes: int = 8) -> Column:
    """3 point 14 as 3.14, in up to passes overlapping places."""
    for _ in range(passes):
        text = F.regexp_replace(text, r"(?i)\b([0-9]+)\s+(?:point|period)\s+([0-9]+)\b", "$1.$2")
    return text


def readability(text: Column, jargon: tuple[str, ...] = ()) -> Column:
    """A struct: words, characters, sentences, syllables, grade (null without words), jargon words, and whether a formula stands there.

    Words are runs of letters, with one apostrophe inside, or numbers. A sentence is what stands between runs of .!? with
    anything visible in it, 1 at least. A syllable is a group of vowels, less a silent e at the end, 1 at least.
    """
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?|[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    spelled = F.filter(found, lambda w: w.rlike("^[A-Za-z]"))
    groups = lambda w: F.size(F.regexp_extract_all(F.lower(w), F.lit("[aeiouy]+"), F.lit(0)))
    each = F.transform(spelled, lambda w: F.greatest(F.lit(1), groups(w) - F.when(F.lower(w).endswith("e") & (groups(w) > 1), 1).otherwise(0)))
    sentences = F.greatest(F.lit(1), F.size(F.filter(F.split(text, "[.!?]+"), lambda p: p.rlike(r"\S"))))
    n, syllables = F.size(found), F.aggregate(each, F.lit(0), lambda s, x: s + x)
    grade = F.when(n > 0, 0.39 * (n / sentences) + 11.8 * F.try_divide(syllables, n) - 15.59)
    formula = text.rlike(r"[=≈≠≤≥±×÷]|\b(?:sin|cos|tan|log|sqrt)\s*\(|\^[0-9]")
    special = F.size(F.filter(found, lambda w: F.lower(w).isin(*jargon))) if jargon else F.lit(0)
    return F.struct(n.alias("words"), F.char_length(text).alias("characters"), sentences.alias("sentences"), syllables.alias("syllables"), grade.alias("grade"), special.alias("jargon"), formula.alias("formula"))


# Section titles that aren't evidence, and the types of text that are.
EXCLUDED_TITLES = ("section summary", "conceptual questions", "problems & exercises", "problems and exercises", "chapter review")
EXCLUDED_PREFIXES = ("test prep",)
EVIDENCE_TYPES = ("body", "example", "figure_caption", "glossary", "table", "equation")


def excluded_section(title: Column) -> Column:
    key = F.trim(F.regexp_replace(folded(F.coalesce(title, F.lit(""))), r"\s+", " "))
    return key.isin(*EXCLUDED_TITLES) | key.rlike("^(?:" + "|".join(EXCLUDED_PREFIXES) + ")")


def inline_heading(text: Column) -> Column:
    """A short heading inside a worked example."""
    return stripped(text).rlike(r"(?i)^(?:strategy|solution|discussion)\b[^\n]{0,20}$")


def record_type(kind: Column, section: Column, text: Column) -> Column:
    """The type of a record from the parser's kind, its section's title and how its text begins: the first rule that holds."""
    title, body = folded(F.coalesce(section, F.lit(""))), folded(stripped(text))
    starts = lambda *prefixes: body.rlike("^(?:" + "|".join(prefixes) + ")")
    # The rules in their order.
    return (
        F.when(kind == "formula", "equation")
        .when(kind == "table", "table")
        .when(kind.isin("figure", "figure_caption"), "figure_caption")
        .when(title.isin("glossary", "key terms"), "glossary")
        .when(title == "section summary", "summary")
        .when(title == "conceptual questions", "conceptual_question")
        .when(title.isin("problems & exercises", "problems and exercises", "chapter review") | title.startswith("test prep"), "problem")
        .when(title.contains("connection for ap") & (kind != "heading"), "sidebar")
        .when(starts("example ", "worked example"), "example")
        .when(starts("check your understanding"), "check_understanding")
        .when(body.contains("learning objectives") | starts("by the end of this section"), "learning_objective")
        .when(starts("phet explorations", "career connection", "real world connections", "making connections", "take-home investigation"), "sidebar")
        .when(kind == "heading", "heading")
        .otherwise("body")
    )


def running_header(text: Column) -> Column:
    """Nothing, or a page number and a title with a dot or bar between them, in either order."""
    return F.coalesce(text, F.lit("")).rlike(r"^$|^[0-9]+\s*[•|]\s*.+$|^.+\s*[•|]\s*[0-9]+$")


def chapter_section(chapter: Column, title: Column) -> Column:
    """(section_id, title) of a heading: its number after the chapter's, or else a slug of the title."""
    number = F.regexp_extract(title, r"^([0-9]+)\.([0-9]+)\s+(.+)$", 2)
    numbered = (F.regexp_extract(title, r"^([0-9]+)\.([0-9]+)\s+(.+)$", 1) == chapter) & (number != "")
    name = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), F.lit("_"))
    name = F.when(F.lower(title).startswith("chapter outline"), "chapter_outline").when(F.lower(title).startswith("introduction"), "introduction").when(name == "", "other").otherwise(name)
    return F.struct(F.concat_ws(".", chapter, F.when(numbered, number).otherwise(name)).alias("section_id"), F.when(numbered, F.trim(F.regexp_extract(title, r"^([0-9]+)\.([0-9]+)\s+(.+)$", 3))).otherwise(title).alias("title"))


def stemmed(term: Column) -> Column:
    """A term without the commonest English endings."""
    n = F.length(term)
    return (
        F.when((n > 5) & term.endswith("ies"), F.concat(F.substring(term, F.lit(1), n - 3), F.lit("y")))
        .when((n > 5) & term.endswith("ing"), F.substring(term, F.lit(1), n - 3))
        .when((n > 4) & term.endswith("ed"), F.substring(term, F.lit(1), n - 2))
        .when((n > 4) & term.endswith("s") & ~term.endswith("ss"), F.substring(term, F.lit(1), n - 1))
        .otherwise(term)
    )


# Typographic quotes and hyphens, and what stands for them.
QUOTES = "‘’‚‛＇“”„‟«»‹›＂"
PLAIN_QUOTES = "'" * 5 + '"' * 9


def title_key(title: Column) -> Column:
    """A title for comparison: plain quotes, folded, single blanks."""
    return F.trim(F.regexp_replace(folded(F.translate(title, QUOTES, PLAIN_QUOTES)), r"\s+", " "))


def alias_key(title: Column) -> Column:
    """title_key without the label and the number in front, as of a chapter or section, or of a range of them.

    A number goes only with what sets it apart from the title: a point or bracket, a dash or colon with a blank behind it, or
    a blank. Where there is nothing of the kind, its last point does. For compatibility forms see functions.unicode.
    """
    digits = "[0-9]+([.][0-9]+)*"
    after = lambda text, part: F.substring(text, F.char_length(part) + 1, F.char_length(text))
    plain = F.ltrim(F.translate(title, QUOTES, PLAIN_QUOTES))
    label = F.regexp_extract(F.lower(plain), r"^(?:chapter|section)\s+", 0)
    rest = after(plain, label)
    number = F.regexp_extract(rest, f"^{digits}", 0)
    behind = after(rest, number)
    range_end = F.regexp_extract(behind, f"^[-–—]{digits}", 0)
    apart = lambda tail: F.when(tail.rlike(r"^\s*[.)]"), F.regexp_replace(tail, r"^\s*[.)]\s*", "")).when(tail.rlike(r"^\s*[-–—:]\s"), F.regexp_replace(tail, r"^\s*[-–—:]\s+", "")).when(tail.rlike(r"^\s"), F.ltrim(tail))
    at_point = lambda part, tail: F.when(F.contains(part, F.lit(".")), F.concat(F.regexp_extract(part, "[0-9]+$", 0), tail))
    beyond = after(behind, range_end)
    ranged = F.when(range_end != "", F.coalesce(apart(beyond), at_point(range_end, beyond)))
    cut = F.coalesce(ranged, apart(behind), at_point(number, behind))
    return title_key(F.when(number != "", F.coalesce(cut, plain)).otherwise(plain))


def natural_key(text: Column) -> Column:
    """A sort key that orders numbers in text by value, behind letters in the same place."""
    parts = F.regexp_extract_all(text, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    key = lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("1"), F.lpad(F.length(digits(p)).cast("string"), 4, "0"), digits(p))).otherwise(F.concat(F.lit("0"), F.lower(p)))
    return F.array_join(F.transform(parts, key), "\u0001")


# Words that coverage and screening leave out.
COVERAGE_STOPS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "do", "does", "describe", "difference", "explain", "for", "from", "how", "in", "is", "it", "of", "on", "or", "please",
    "that", "the", "to", "what", "when", "which", "why", "who", "with",
)


def coverage_terms(text: Column) -> Column:
    """The set of a text's stemmed terms of two characters or more, without stop words."""
    return F.array_distinct(F.transform(F.filter(search_terms(text), lambda t: ~t.isin(*COVERAGE_STOPS) & (F.length(t) > 1)), stemmed))


# Words that screening leaves out.
SCREENING_STOPS = (
    "about", "after", "again", "also", "because", "being", "between", "could", "does", "from", "have", "into", "more", "most", "other", "over", "same", "such", "than", "that",
    "their", "there", "these", "they", "this", "those", "through", "under", "what", "when", "where", "which", "while", "with", "would", "your", "will", "were", "been", "each",
    "how", "whose",
)


def screening_terms(text: Column) -> Column:
    """The set of a-z and 0-9 words of three characters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*SCREENING_STOPS)))
