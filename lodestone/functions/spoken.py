"""Formulas as a voice reads them, brought back to signs, with how far the result can be trusted.

A formula is read as tokens by a small grammar: fractions first, whose parts are formulas themselves; then names with what
stands below and above them, averages, powers, brackets and signs. What the grammar doesn't know stays as it is spoken, and
words that still name a part of a formula make the result doubtful. Texts come in Arrow batches; a batch's distinct texts
are read once.
"""

from __future__ import annotations

import re
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spoken phrases and what they stand for, longer ones first where one begins another; words that are left when a
# formula wasn't understood; units behind which a spoken minus is a dash; fractions of a text at most.
SIGNS = {
    "to the second power": "²",
    "to the third power": "³",
    "squared": "²",
    "cubed": "³",
    "open paren": "(",
    "close paren": ")",
    "plus or minus": "±",
    "negative": "−",
    "positive": "+",
    "equals": "=",
    "plus": "+",
    "minus": "−",
    "slash": "/",
    "over": "/",
    "times": "×",
    "comma": ",",
    "period": ".",
    "close brace": "",
    "prime": "′",
    "triangle": "Δ",
    "delta": "Δ",
}
DOUBTFUL = {"numerator", "denominator", "fraction", "sub", "sup", "bar", "cap", "raised", "power", "blank", "also", "root", "integral"}
UNITS = {"m", "s", "kg", "n", "j", "w", "pa"}
AVERAGES = {"v": ("v̄", ("equals", "squared", "t")), "a": ("ā", ("equals", "squared"))}
FRACTIONS = 8
START, MIDDLE = "the fraction with numerator", "and denominator"

TOKEN = re.compile(r"\s+|\d+(?:\.\d+)+|\w+|[^\w\s]")


def spaced(phrase: str) -> list[str]:
    """A phrase's tokens: words and the blanks between them."""
    return TOKEN.findall(phrase)


PHRASES = [(spaced(p), sign) for p, sign in SIGNS.items()]


def stands(tokens: list[str], i: int, phrase: list[str]) -> bool:
    """Whether a phrase stands at token i, in any case and with single blanks, as prose has them."""
    return [t.lower() for t in tokens[i : i + len(phrase)]] == phrase


def find(tokens: list[str], i: int, phrase: list[str]) -> int:
    return next((k for k in range(i, len(tokens) - len(phrase) + 1) if stands(tokens, k, phrase)), -1)


def blank(tokens: list[str], i: int) -> bool:
    return 0 <= i < len(tokens) and tokens[i].isspace()


def fractions(tokens: list[str]) -> tuple[list[str], int]:
    """Fractions as (numerator)/(denominator), the first one first, and how many there were.

    A denominator is a token at least and goes on to an equals sign, to the constants that a product ends with, to a spoken comma or
    period, or to the end.
    """
    start, middle, count = spaced(START), spaced(MIDDLE), 0
    ends = [spaced("equals"), spaced("times open paren constant"), spaced("comma"), spaced("period")]
    at = find(tokens, 0, start)
    while at >= 0 and count < FRACTIONS:
        top = at + len(start) + 1
        mid = find(tokens, top + 2, middle)
        if mid < 0:
            break
        low = mid + len(middle) + 1
        stop = next((k for k in range(low + 1, len(tokens)) if blank(tokens, k) and any(stands(tokens, k + 1, e) and (j or blank(tokens, k + 2)) for j, e in enumerate(ends))), len(tokens))
        if low >= len(tokens):
            break
        trim = lambda part: TOKEN.findall("".join(part).strip())
        tokens = [*tokens[:at], "(", *trim(tokens[top:mid]), ")", "/", "(", *trim(tokens[low:stop]), ")", *tokens[stop:]]
        count += 1
        at = find(tokens, 0, start)
    return tokens, count


def dashes(tokens: list[str]) -> list[str]:
    """4.0 minus m, where the dash only parts a number from its unit, as 4.0 m."""
    out, i = [], 0
    while i < len(tokens):
        number = tokens[i][0].isdigit() and re.fullmatch(r"\d+(\.\d+)*", tokens[i])
        if number and blank(tokens, i + 1) and blank(tokens, i + 3) and i + 4 < len(tokens) and tokens[i + 2].lower() == "minus" and tokens[i + 4].lower() in UNITS:
            out += [tokens[i], " ", tokens[i + 4]]
            i += 5
        else:
            out.append(tokens[i])
            i += 1
    return out


def letters(token: str) -> bool:
    return re.fullmatch("[A-Za-zΔ]+", token) is not None


def names(tokens: list[str]) -> list[str]:
    """Changes of a quantity (Δx), what stands below a name (x_0) and above it (x^2), and primes of letters with an index."""
    out, i = [], 0
    while i < len(tokens):  # Δ before a single letter
        if tokens[i].lower() in ("triangle", "delta") and blank(tokens, i + 1) and i + 2 < len(tokens) and re.fullmatch("[A-Za-z]", tokens[i + 2]):
            out.append("Δ" + tokens[i + 2])
            i += 3
        else:
            out.append(tokens[i])
            i += 1
    for word, mark in (("sub", "_"), ("sup", "^")):
        tokens, out, i = out, [], 0
        while i < len(tokens):
            if letters(tokens[i]) and i + 4 < len(tokens) and blank(tokens, i + 1) and blank(tokens, i + 3) and tokens[i + 2].lower() == word and re.fullmatch("[A-Za-z0-9]+", tokens[i + 4]):
                out.append(tokens[i] + mark + tokens[i + 4])
                i += 5
            else:
                out.append(tokens[i])
                i += 1
    tokens, out, i = out, [], 0
    while i < len(tokens):
        index = tokens[i + 2][6:] if i + 2 < len(tokens) and tokens[i + 2].lower().startswith("prime_") else ""
        if index and blank(tokens, i + 1) and re.fullmatch("[A-Za-z]", tokens[i]):
            out.append(f"{tokens[i]}′_{index}")
            i += 3
        else:
            out.append(tokens[i])
            i += 1
    return out


def averages(tokens: list[str]) -> list[str]:
    """v minus and a minus, where what follows shows that the minus is a bar over the letter."""
    out, i = [], 0
    while i < len(tokens):
        bar, follows = AVERAGES.get(tokens[i].lower(), (None, ()))
        if bar and blank(tokens, i + 1) and i + 2 < len(tokens) and tokens[i + 2].lower() == "minus":
            rest = i + 3
            word = tokens[rest + 1].lower() if blank(tokens, rest) and rest + 1 < len(tokens) else ""
            end = next((t for t in tokens[rest : rest + 2] if not t.isspace()), "")
            if word in follows or end in (",", ".", ";") or not end:
                out.append(bar)
                i += 3
                continue
        out.append(tokens[i])
        i += 1
    return out


def signs(tokens: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(tokens):
        phrase, sign = next(((p, s) for p, s in PHRASES if stands(tokens, i, p)), (None, ""))
        out.append(tokens[i] if phrase is None else sign)
        i += len(phrase) if phrase else 1
    return out


def laid_out(text: str) -> str:
    """Blanks around signs and inside brackets, constants behind a semicolon, and lines of a derivation in a row."""
    text = re.sub(r"\s+(?=[,.;)])", "", text)
    text = re.sub(r"(?<=\()\s+", "", text)
    text = re.sub(r"\s*×\s*\(constant\s+([A-Za-z])\)", r"; constant \1", text, flags=re.I)
    text = re.sub(r"^\d+\s+lines?\s+", "", text, flags=re.I)
    text = re.sub(r"\bLine\s+\d+\s*:\s*", "; ", text, flags=re.I).lstrip("; ")
    for sign in "=+×/−":
        text = f" {sign} ".join(part.strip() if k else part.rstrip() for k, part in enumerate(text.split(sign)))
    return " ".join(text.split())


def formula(prose: str) -> tuple[str, str]:
    """(shown, trust) of a formula in normal prose: high, medium with a fraction, or low."""
    prose = re.sub(r"\bnumber\s+(?=\d)", "", prose, flags=re.I)
    prose = re.sub(r"\bmasculine ordinal indicator\b", "°", prose, flags=re.I)
    tokens, parts = fractions(dashes(TOKEN.findall(decimals(prose))))
    shown = laid_out("".join(signs(averages(names(tokens)))))
    doubt = any(w.lower() in DOUBTFUL for w in re.findall(r"\w+", shown))
    return shown, "low" if doubt else "medium" if parts else "high"


def decimals(prose: str) -> str:
    """3 point 14 as 3.14. Two passes: the second joins what shares a number with what the first has joined."""
    for _ in range(2):
        prose = re.sub(r"\b(\d+)\s+(?:point|period)\s+(\d+)\b", r"\1.\2", prose, flags=re.I)
    return prose


def one_line(text: str) -> str:
    """Normal prose of a spoken text: as functions.text.rejoined_prose of its compatibility composition."""
    lines = re.split(r"\s*\n\s*", normalize("NFKC", text).replace("\u00ad", "").replace("\r", "\n"))
    out = []
    for line, following in zip(lines, [*lines[1:], ""]):
        cut = re.search(r"\w-$", line) and re.match("[a-z]", following)
        out.append(line[:-1] if cut else line + " ")
    return re.sub(r"[\t ]+", " ", "".join(out)).strip()


@F.pandas_udf(T.StructType([T.StructField("shown", T.StringType()), T.StructField("trust", T.StringType())]))
def _read(texts: pd.Series) -> pd.DataFrame:
    known = {t: formula(one_line(t)) for t in texts.dropna().unique()}
    return pd.DataFrame([known.get(t, (None, None)) for t in texts], columns=["shown", "trust"])


def read_formula(text: Column) -> Column:
    """A struct (shown, trust) of a formula's spoken text: signs instead of words, and high, medium or low trust; null for null.

    Texts come in compatibility composition and as normal prose. medium: fractions were put together; low: words are left that name
    parts of a formula.
    """
    return _read(text)
