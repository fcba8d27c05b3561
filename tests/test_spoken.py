"""Spoken formulas."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import spoken, text

CASES = [
    ("v equals v sub 0 plus a t", "v = v_0 + a t", "high"),
    ("triangle x equals x sub f minus x sub 0", "Δx = x_f − x_0", "high"),
    ("Delta v over delta t", "Δv / Δt", "high"),
    ("F equals m times a", "F = m × a", "high"),
    ("v minus equals the fraction with numerator v sub 0 plus v and denominator 2", "v̄ = (v_0 + v) / (2)", "medium"),
    ("a minus equals the fraction with numerator triangle v and denominator triangle t equals 3 point 0 m", "ā = (Δv) / (Δt) = 3.0 m", "medium"),
    ("v minus v sub 0", "v − v_0", "high"),
    ("v minus squared plus v minus t", "v̄ ² + v̄ t", "high"),
    ("x equals the fraction with numerator 1 and denominator 2 comma y equals 4 period", "x = (1) / (2), y = 4.", "medium"),
    ("the fraction with numerator G and denominator r squared times open paren constant k close paren", "(G) / (r ²); constant k", "medium"),
    ("4.0 minus m plus 2 minus kg", "4.0 m + 2 kg", "high"),
    ("number 3 point 14 number 15", "3.14 15", "high"),
    ("1 point 2 point 3 period 4", "1.2.3.4", "high"),
    ("90 masculine ordinal indicator", "90 °", "high"),
    ("open paren x plus y close paren to the second power", "(x + y) ²", "high"),
    ("plus or minus 3 slash 4", "± 3 / 4", "high"),
    ("negative 3 equals positive 2 minus 5", "− 3 = + 2 − 5", "high"),
    ("v prime sub 0 plus x prime", "v′_0 + x ′", "high"),
    ("x sup 2", "x^2", "high"),
    ("x sub 0 sup 2", "x_0 sup 2", "low"),
    ("the root of x cubed", "the root of x ³", "low"),
    ("2 lines Line 1: x equals 1 Line 2: y equals 2", "x = 1 ; y = 2", "high"),
    ("close brace x", "x", "high"),
    ("the fraction with numerator a", "the fraction with numerator a", "low"),
    ("EQUALS Plus", "= +", "high"),
    ("sub-\nmarine plus\n  one", "submarine + one", "high"),
    ("", "", "high"),
    (None, None, None),
]


def test_hand_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, t string").repartition(3)
    got = {r.i: (r.f.shown, r.f.trust) if r.f else (None, None) for r in df.select("i", spoken.read_formula(F.col("t")).alias("f")).collect()}
    assert [got[i] for i in range(len(CASES))] == [(shown, trust) for _, shown, trust in CASES]


def test_what_has_no_spoken_words_stays():
    for plain in ("x = 3", "Ohm's law, 1826; see p. 4", "日本 q̈"):
        assert spoken.formula(plain) == (plain, "high")


def test_many_fractions_and_long_texts():
    one = "the fraction with numerator a and denominator b comma "
    shown, trust = spoken.formula((one * 8).strip())
    assert shown == ", ".join(["(a) / (b)"] * 8) + "," and trust == "medium"
    shown, trust = spoken.formula((one * 9).strip())
    assert trust == "low" and shown.count("(a) / (b)") == 8
    assert spoken.formula("x plus " * 20_000)[0].count("+") == 20_000


def test_decimals_reach_a_fixed_point(spark):
    chain = " point ".join(map(str, range(700)))
    got = spark.createDataFrame([(chain,)], "t string").select(text.spoken_decimals(F.col("t"), passes=2).alias("t")).head().t
    assert got == ".".join(map(str, range(700))) == spoken.decimals(chain)


@pytest.mark.parametrize("word", sorted(spoken.SIGNS))
def test_every_sign_is_read_alone(word):
    sign = spoken.SIGNS[word]
    assert spoken.formula(f"x1 {word} y1")[0].replace(" ", "") == f"x1{sign}y1"
