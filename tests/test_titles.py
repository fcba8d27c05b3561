"""Titles, prose and folds by hand."""

from pyspark.sql import functions as F

from lodestone.functions import text, unicode

ALIASES = {
    "Chapter 3.12  Motion": "motion",
    "  SECTION 2: The “Wave”": 'the "wave"',
    "12.4-12.7: Waves": "waves",
    "12.4–12.7 Waves": "waves",
    "1. Intro": "intro",
    "2) X": "x",
    "3 - Title": "title",
    "3-Title": "3-title",
    "3: Title": "title",
    "3:Title": "3:title",
    "Section 4": "section 4",
    "1.5": "5",
    "1-2.5x": "5x",
    "7.": "",
    "10 things": "things",
    "Chapters 3 x": "chapters 3 x",
    "chapter   Motion": "chapter motion",
    "Straße": "strasse",
    "": "",
    None: None,
}


def test_alias_keys(spark):
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in ALIASES], "t string").select("t", text.alias_key(F.col("t")).alias("k")).collect()}
    assert got == ALIASES


def test_compatibility_forms_are_folded_first(spark):
    cases = {"１２．３ Ｗａｖｅｓ": "waves", "ﬁrst STRASSE ß": "first strasse ss", "Ⅳ. Ohm": "iv. ohm", "ΣΊΣΥΦΟΣ": "σίσυφοσ", None: None}
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.alias_key(unicode.compat_fold("t")).alias("k")).collect()}
    assert got == cases


def test_prose_is_one_line(spark):
    cases = {
        "a hy-\n  phen and a Pro-\nNoun - \n x": "a hyphen and a Pro- Noun - x",
        "one \r\n two\rthree\n\n\nfour\t\tfive": "one two three four five",
        "é-\né": "é- é",
        "soft­ened 1-\nst": "softened 1st",
        "  \n ": "",
        "": "",
        None: None,
    }
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.rejoined_prose(F.col("t")).alias("k")).collect()}
    assert got == cases
    long = "line of words-\nand more\n" * 100_000
    assert len(spark.createDataFrame([(long,)], "t string").select(text.rejoined_prose(F.col("t")).alias("k")).head().k) == 22 * 100_000 - 1
