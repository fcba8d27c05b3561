"""Where quotes stand in texts whose white space and Unicode composition may differ from theirs.

A text is brought to its normal form together with a map that leads from each character of that form back to the
characters it comes from. The map is monotone, so a quote that is found in the normal form has one place in the text.
A text is normalised once for a block of quotes, and an automaton finds all of them in one pass.
"""

from __future__ import annotations

from collections import Counter
from unicodedata import combining, is_normalized, normalize

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that a quote's normal form needs, and quotes of a text that are looked for in one pass.
LEAST, BLOCK = 40, 1 << 10
#: Blocks of Hangul jamo, which compose although their combining class is 0.
JAMO = ((0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF))


def jamo(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in JAMO)


def clusters(text: str) -> np.ndarray:
    """The first characters of what composes together: a base and its marks, or jamo in a row."""
    kinds = {c: (combining(c) != 0, jamo(c)) for c in set(text)}
    if not any(mark or j for mark, j in kinds.values()):
        return np.arange(len(text))
    first, syllable = [], False
    for i, c in enumerate(text):
        mark, j = kinds[c]
        if not i or not (mark or (j and syllable)):
            first.append(i)
            syllable = j
        syllable |= j
    return np.array(first)


def normal(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The canonically composed text with single blanks for white space, and for each of its characters the span it comes from."""
    if not text:
        return "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = clusters(text)
    end = np.append(first[1:], len(text))
    if len(first) == len(text) and is_normalized("NFC", text):
        chars, size = text, np.ones(len(text), np.int64)
    else:
        pieces = [normalize("NFC", text[a:b]) for a, b in zip(first.tolist(), end.tolist())]
        chars, size = "".join(pieces), np.array([len(p) for p in pieces], np.int64)
    starts, ends = np.repeat(first, size), np.repeat(end, size)
    blank = np.array([c.isspace() for c in chars], bool)
    head = ~blank
    head[1:] |= blank[1:] & ~blank[:-1]
    head[:1] = True
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(chars)) - 1  # a blank stands for all its run
    out = "".join(" " if blank[i] else chars[i] for i in at.tolist())
    starts, ends = starts[at], ends[last]
    a, b = len(out) - len(out.lstrip(" ")), len(out.rstrip(" "))
    return out[a:b], starts[a:b], ends[a:b]


def normal_quote(quote: str) -> str:
    return " ".join(normalize("NFC", quote).split())


def places(text: str, quotes: set[str]) -> tuple[Counter, dict[str, int]]:
    """How often each quote stands in a text, overlaps included, and where it stands last."""
    import ahocorasick

    count, at = Counter(), {}
    quotes.discard("")
    if quotes:
        automaton = ahocorasick.Automaton()
        for q in quotes:
            automaton.add_word(q, q)
        automaton.make_automaton()
        for last, q in automaton.iter(text):
            count[q] += 1
            at[q] = last + 1 - len(q)
    return count, at


def located(text: str | None, quotes: list[str | None], least: int) -> list[tuple[str, int | None, int | None]]:
    """(status, start, end) of each quote: exact, normal, ambiguous, absent or short."""
    wanted = [normal_quote(q or "") for q in quotes]
    held = [i for i, w in enumerate(wanted) if len(w) >= least]
    out: list[tuple[str, int | None, int | None]] = [("short", None, None)] * len(quotes)
    if not held:
        return out
    own, starts, ends = normal(text or "")
    exact, exact_at = places(text or "", {quotes[i] for i in held})
    count, at = places(own, {wanted[i] for i in held})
    for i in held:
        quote, w = quotes[i], wanted[i]
        if exact[quote] > 1 or count[w] > 1:
            out[i] = ("ambiguous", None, None)
        elif not count[w]:
            out[i] = ("absent", None, None)
        elif exact[quote]:
            out[i] = ("exact", exact_at[quote], exact_at[quote] + len(quote))
        else:
            out[i] = ("normal", int(starts[at[w]]), int(ends[at[w] + len(w) - 1]))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("status", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def _located(texts: pd.Series, quotes: pd.Series, least: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("status", "start", "end"), x)) for x in located(t, list(q), int(n))] for t, q, n in zip(texts, quotes, least)], dtype=object)


def claims_of(text: str | None, quotes: list[str | None], places_: list[int | None]) -> list[tuple[bool, bool, int, int | None]]:
    """(known, there, found, first) of quotes that are said to stand at some places: one pass over the text for all of them."""
    import ahocorasick

    if text is None:
        return [(False, False, 0, None)] * len(quotes)
    wanted = {q for q in quotes if q}
    said = set(zip(quotes, places_))
    found, free, first, there = Counter(), {}, {}, set()
    if wanted:
        automaton = ahocorasick.Automaton()
        for q in wanted:
            automaton.add_word(q, q)
        automaton.make_automaton()
        for last, q in automaton.iter(text):
            start = last + 1 - len(q)
            first.setdefault(q, start)
            if (q, start) in said:
                there.add((q, start))
            if start >= free.get(q, 0):  # places that don't overlap, from the left
                found[q] += 1
                free[q] = last + 1
    return [(True, (q, a) in there, found[q], first.get(q)) for q, a in zip(quotes, places_)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("known", T.BooleanType()), T.StructField("there", T.BooleanType()), T.StructField("found", T.LongType()), T.StructField("first", T.LongType())])))
def _claimed(texts: pd.Series, quotes: pd.Series, places_: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("known", "there", "found", "first"), x)) for x in claims_of(t, list(q), [None if a is None or a != a else int(a) for a in p])] for t, q, p in zip(texts, quotes, places_)], dtype=object)


def claimed_places(texts: DataFrame, claims: DataFrame) -> DataFrame:
    """claims (claim, doc_id, at, quote) with known (its text is there), there (the quote stands at that place), found and first.

    found counts places that don't overlap, from the left; first is the first place of all. texts: doc_id, text. A text's
    claims are dealt in blocks, each of which reads the text once. A null or empty quote is found nowhere; repeated rows of
    texts repeat the claims.
    """
    parts = claims.groupBy(F.col("doc_id").alias("pid")).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = claims.join(parts, F.col("doc_id").eqNullSafe(F.col("pid"))).select("claim", "doc_id", "at", "quote", F.pmod(F.xxhash64("quote", "at"), F.col("parts")).alias("part"))
    blocks = dealt.groupBy("doc_id", "part").agg(F.collect_list(F.struct("claim", "at", "quote")).alias("own"))
    met = blocks.join(texts.select(F.col("doc_id").alias("tid"), "text"), F.col("doc_id") == F.col("tid"), "left")
    found = met.select("doc_id", "own", _claimed("text", F.col("own.quote"), F.col("own.at")).alias("met"))
    each = found.select("doc_id", F.explode(F.arrays_zip("own", "met")).alias("x"))
    return each.select("x.own.claim", "doc_id", "x.own.at", "x.own.quote", "x.met.*")


def locate_quotes(texts: DataFrame, quotes: DataFrame, *, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", quote_id: str = "quote_id", quote_col: str = "quote") -> DataFrame:
    """(quote_id, doc_id, status, start, end), one row per quote: where it stands in its text, in the text's own characters.

    exact: as it is, and nowhere else; normal: once when both are brought to their normal form, where start and end are those of
    the characters that it comes from; ambiguous: several times, overlaps counted, in either form; absent; short: its normal form
    has fewer than least characters. A quote whose text is null or unknown is absent, a null quote is short. Repeated rows of
    texts give repeated rows; quotes of one text are looked for in blocks, so no task holds all of a text's quotes. Further
    columns are left out.
    """
    wanted = quotes.select(F.col(quote_id).alias("qid"), F.col(id_col).alias("did"), F.col(quote_col).alias("quote"))
    parts = wanted.groupBy(F.col("did").alias("pid")).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = wanted.join(parts, F.col("did").eqNullSafe(F.col("pid"))).select("qid", "did", "quote", F.pmod(F.xxhash64("qid", "quote"), F.col("parts")).alias("part"))
    blocks = dealt.groupBy("did", "part").agg(F.collect_list(F.struct("qid", "quote")).alias("own"))
    met = blocks.join(texts.select(F.col(id_col).alias("tid"), F.col(text_col).alias("text")), F.col("did") == F.col("tid"), "left")
    found = met.select("did", "own", _located("text", F.col("own.quote"), F.lit(least)).alias("found"))
    each = found.select("did", F.explode(F.arrays_zip("own", "found")).alias("x"))
    return each.select(F.col("x.own.qid").alias(quote_id), F.col("did").alias(id_col), "x.found.status", F.col("x.found.start").alias("start"), F.col("x.found.end").alias("end"))
