"""Conversion of older gold."""

import pytest

from lodestone.operators import anchoring, goldform

E = "struct<span_id: string, chapter_id: string, char_start: long, char_end: long, chapter_char_start: long, chapter_char_end: long, verbatim_text: string, block_id: string, sufficiency: string, annotation_note: string>"
GOLD = f"question_id string, split string, corpus_version string, source_corpus_version string, core array<array<{E}>>, partial array<{E}>"
CHUNK = "textbook_id string, chapter_id string, chunk_id string, text string, blocks array<string>"
CHUNKS = [("t1", "c1", "k1", "alpha beta gamma", ["b1"]), ("t2", "c1", "k2", "alpha delta", ["b2"]), ("t1", "c1", "k3", "alpha again", None), ("t3", "c2", "k4", "alpha beta gamma", ["b1"]), (None, "c1", "k5", "omega", None), ("t1", "c1", "k6", None, None)]


def ev(quote, *, chapter="c1", block=None, start=5, own=None, sufficiency="full", note="", span="s"):
    return (span, chapter, start, start + 4, own, None, quote, block, sufficiency, note)


def convert(spark, *gold, strict=False, **further):
    return goldform.converted(spark.createDataFrame(list(gold), GOLD), spark.createDataFrame(CHUNKS, CHUNK), "v2", strict=strict, **further)


@pytest.mark.parametrize("parts", [(1 << 22, 1 << 10), (10, 1)])
def test_both_forms_convert_and_keep_what_they_have(spark, monkeypatch, parts):
    monkeypatch.setattr(anchoring, "PART_CHARS", parts[0])
    monkeypatch.setattr(anchoring, "PART_SPANS", parts[1])
    first = ("q1", "pending", "v0", None, [[ev("beta", span="a"), ev("delta", own=5, span="b")], [], [ev("alpha", block="b2", note="why", span="c")]], [ev("again", span="d")])
    second = ("q2", "dev", "v1", "v0.5", [[ev("beta gamma", chapter="c2", block="b1")]], [])
    got = {r.question_id: r for r in convert(spark, first, second, splits={"pending": "test"}, strict=True).collect()}
    one = got["q1"]
    assert (one.split, one.source_corpus_version, one.corpus_version, one.refused) == ("test", "v0", "v2", [])
    assert [[(e.span.span_id, e.span.textbook_id, e.annotation_note) for e in g] for g in one.core] == [[("a", "t1", None), ("b", "t2", None)], [], [("c", "t2", "why")]]
    assert [(e.span.textbook_id, e.span.chapter_char_start, e.span.chapter_char_end, e.span.origin_corpus_version) for e in one.partial] == [("t1", 5, 9, "v0")]
    two = got["q2"]
    assert (two.split, two.source_corpus_version, two.core[0][0].span.textbook_id, two.core[0][0].span.origin_corpus_version) == ("dev", "v0.5", "t3", "v0.5")


def test_what_is_refused(spark):
    bad = {"alpha": (ev("alpha"), goldform.BOOK), "none": (ev("nowhere"), goldform.BOOK), "empty": (ev(""), goldform.BOOK), "block": (ev("beta", block="b9"), goldform.BOOK), "book": (ev("omega"), goldform.BOOK), "chapter": (ev("beta", chapter=None), goldform.UNANNOTATED), "sufficiency": (ev("beta", sufficiency=None), goldform.UNANNOTATED), "offset": (ev("beta", own=6), goldform.OFFSETS)}
    rows = [(name, "dev", "v0", None, [[e]], []) for name, (e, _) in bad.items()]
    assert {r.question_id: r.refused for r in convert(spark, *rows).collect()} == {name: [why] for name, (_, why) in bad.items()}
    for row in rows[:1] + rows[-1:]:
        with pytest.raises(Exception, match="GOLD: "):
            convert(spark, row, strict=True).collect()
    good = ("q", "dev", "v0", None, [[ev("beta")]], [])
    for wrong in ((good, good), ((None, *good[1:]),)):
        with pytest.raises(Exception, match="twice or without id"):
            convert(spark, *wrong).collect()
    assert convert(spark, good).limit(0).count() == 0
    assert convert(spark, ("q", "dev", "v0", None, [], [])).collect()[0].core == []


def test_maps_of_splits(spark):
    good = ("q", "proposed_test", "v0", None, [[ev("beta")]], [])
    assert convert(spark, good, splits={"q": "dev"}).collect()[0].split == "dev"
    assert convert(spark, good, splits={"pending": "dev"}).collect()[0].split == "proposed_test"
    with pytest.raises(Exception, match="not in the map"):
        convert(spark, good, splits={"other": "dev"}).collect()
    for wrong in ({"dev": "test"}, {"pending": "later"}):
        with pytest.raises(ValueError):
            convert(spark, good, splits=wrong)
