"""Evidence spans and quotes against brute force."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.operators import anchoring, quoting

CHUNK = "textbook_id string, chapter_id string, document_id string, chunk_id string, char_start long, char_end long, text string, spans array<struct<block_id: string, char_start: long, char_end: long>>, parent_scope string, parent_char_start string"
SPAN = "span_id string, textbook_id string, chapter_id string, block_id string, chapter_char_start long, chapter_char_end long, verbatim_text string"


def all_places(text, quote):
    return [i for i in range(len(text) - len(quote) + 1) if text.startswith(quote, i)]


def reader(chunks, span):
    """The rule read out: (status, method, document, start, end, chunk ids)."""
    own = [c for c in chunks if c[0] is not None and c[1] is not None and c[:2] == span[1:3]]
    quote = span[6]
    found = []
    for doc in {c[2] for c in own}:
        mine = sorted((c for c in own if c[2] == doc), key=lambda c: (c[4], c[3]))
        runs, starts = [], set()
        for c in mine:
            if runs and c[4] - runs[-1][-1][5] in (0, 2):
                runs[-1].append(c)
            else:
                runs.append([c])
            if c[8] == "chapter" and c[9] and c[9].isdigit() and int(c[9]) <= c[4]:
                starts.add(int(c[9]))
        base = starts.pop() if len(starts) == 1 else None
        for run in runs:
            text = "".join(("\n\n" if i and c[4] - run[i - 1][5] == 2 else "") + (c[6] or "") for i, c in enumerate(run))
            for at in all_places(text, quote) if quote else []:
                a, b = run[0][4] + at, run[0][4] + at + len(quote)
                over = [c for c in run if max(a, c[4]) < min(b, c[5])]
                if over and over[0][4] <= a and over[-1][5] >= b:
                    inside = span[3] is not None and any(s[0] == span[3] and max(s[1], c[4]) <= a and b <= min(s[2], c[5]) for c in run for s in c[7] or [])
                    found.append((inside, base is not None and (a, b) == (base + (span[4] or 0), base + (span[5] or 0)) and span[4] is not None, (doc, a, b, tuple(c[3] for c in over))))
    block, hit, both = [x for x in found if x[0]], [x for x in found if x[1]], [x for x in found if x[0] and x[1]]
    if len(both) == 1 or len(block) == 1:
        return ("resolved", "block_id", *(both if len(both) == 1 else block)[0][2])
    if hit:
        return ("resolved", "chapter_offset", *hit[0][2]) if len(hit) == 1 else ("ambiguous", None, None, None, None, None)
    if len(found) == 1:
        return ("resolved", "verbatim_unique", *found[0][2])
    return ("ambiguous" if found else "stale", None, None, None, None, None)


def resolved(spark, chunks, spans):
    df = spark.createDataFrame(chunks, CHUNK).withColumn("run", F.lit("clash")).withColumn("base", F.lit(1))
    got = anchoring.resolve(df, spark.createDataFrame(spans, SPAN).withColumn("s", F.lit(9))).collect()
    assert len(got) == len(spans)
    return {r.span_id: (r.status, r.method, r.document_id, r.start, r.end, r.chunk_ids and tuple(r.chunk_ids)) for r in got}


@pytest.mark.parametrize("parts", [(1 << 22, 1 << 10), (60, 3)])
def test_spans_match_a_plain_reader(spark, monkeypatch, parts):
    monkeypatch.setattr(anchoring, "PART_CHARS", parts[0])
    monkeypatch.setattr(anchoring, "PART_SPANS", parts[1])
    rng = random.Random(4)
    chunks, spans = [], []
    for d in range(24):
        at, book, chapter = rng.choice([0, 50]), f"b{d % 2}", f"c{d % 3}"
        for k in range(rng.randint(1, 7)):
            text = "".join(rng.choice("ab é\n") for _ in range(rng.choice([0, 3, 9, 20])))
            cut = at + len(text) // 2
            spans_of = rng.choice([None, [], [(f"k{k}", at, at + len(text))], [(f"{d}-{k}", at, cut), (f"k{k}", cut, at + len(text) + 5)]])
            chunks.append((book, chapter, f"d{d}", f"d{d}-{k}", at, at + len(text), text, spans_of, rng.choice(["chapter", "chapter", "section", None]), rng.choice(["0", "0", "50", "x", None])))
            at += len(text) + rng.choice([0, 2, 2, 1, 3])
    for i in range(160):
        c = chunks[rng.randrange(len(chunks))]
        later = [x for x in chunks if x[2] == c[2] and x[4] >= c[4]][:3]
        text = "".join(("\n\n" if j and x[4] - later[j - 1][5] == 2 else "") + x[6] for j, x in enumerate(later))
        a = rng.randint(0, max(0, len(text) - 1))
        quote = text[a : a + rng.choice([1, 2, 5, 12, 30])]
        spans.append((f"s{i}", c[0], c[1], rng.choice([None, f"k{rng.randint(0, 6)}", c[7][0][0] if c[7] else None]), c[4] + a, c[4] + a + len(quote), rng.choice([quote, quote, quote, quote + "!"])))
    spans += [("n1", None, "c0", None, 0, 1, "a"), ("n2", "b0", "c0", None, 0, 1, None), ("n3", "b0", "c0", None, None, None, "ab"), ("n4", "nowhere", "c0", "k1", 0, 1, "a"), ("n5", "b0", "c0", "k1", 0, 0, "")]
    got = resolved(spark, chunks, spans)
    want = {s[0]: reader(chunks, s) for s in spans}
    assert got == want
    assert {(s, m) for s, m, *_ in want.values()} == {("resolved", "block_id"), ("resolved", "chapter_offset"), ("resolved", "verbatim_unique"), ("ambiguous", None), ("stale", None)}
    assert any(ids and len(ids) > 1 for *_, ids in want.values())


def test_spans_without_chunks_are_stale(spark):
    spans = [("s", "b", "c", None, 0, 1, "a")]
    assert resolved(spark, [], spans) == {"s": ("stale", None, None, None, None, None)}
    assert resolved(spark, [("b", "c", "d", "k", 0, 1, "a", None, None, None)], []) == {}


def plain_reader(text, quote, least):
    """A second way to the same places: normal forms of all slices of the text between its clusters."""
    wanted = quoting.normal_quote(quote or "")
    if len(wanted) < least:
        return "short", None, None
    text = text or ""
    exact = all_places(text, quote)
    own = quoting.normal_quote(text)
    n = all_places(own, wanted)
    if len(exact) > 1 or len(n) > 1:
        return "ambiguous", None, None
    if not n:
        return "absent", None, None
    if exact:
        return "exact", exact[0], exact[0] + len(quote)
    edges = [*quoting.clusters(text).tolist(), len(text)]
    hits = [(a, b) for i, a in enumerate(edges) for b in edges[i + 1 :] if quoting.normal_quote(text[a:b]) == wanted]
    a = max(a for a, _ in hits)
    return "normal", a, min(b for x, b in hits if x == a)


def test_quotes_match_a_plain_reader(spark):
    rng = random.Random(9)
    letters = ["a", "b", "é", "é", "ö", "한", "가", "q̈́", "Å", "日"]
    blanks = [" ", "  ", "\n", " ", "\t \r\n", " "]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))
    texts = [(i, "".join(rng.choice(["", " "]) + word() + rng.choice(blanks) for _ in range(rng.randint(1, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "ab " * 60)]
    quotes = []
    for i, text in texts:
        edges = [*quoting.clusters(text or "").tolist(), len(text or "")]
        for j in range(6):
            a, b = sorted(rng.sample(edges, 2)) if len(edges) > 2 else (0, 0)
            quote = (text or "")[a:b]
            quote = rng.choice([quote, unicodedata.normalize("NFD", quote), unicodedata.normalize("NFC", quote), " ".join(quote.split()), quote.replace(" ", " \n"), quote + "x"])
            quotes.append((i * 10 + j, i, quote))
    quotes += [(1000, 5, None), (1001, 777, "not there at all"), (1002, None, "no text"), (1003, 92, "ab ab ab"), (1004, 90, "abc")]
    # long ones of equal length in one text, so that blocks are dealt
    df = quoting.locate_quotes(spark.createDataFrame(texts, "doc_id long, text string").withColumn("own", F.lit(1)), spark.createDataFrame(quotes, "quote_id long, doc_id long, quote string").withColumn("part", F.lit(0)), least=3)
    got = {r.quote_id: (r.status, r.start, r.end) for r in df.collect()}
    by = dict(texts)
    want = {q: plain_reader(by.get(i), quote, 3) for q, i, quote in quotes}
    assert got == want
    assert {s for s, _, _ in want.values()} == {"exact", "normal", "ambiguous", "absent", "short"}


def test_offsets_lead_back():
    """Round trip: what a normal form's characters come from has that normal form."""
    for text in ("  Plain  text\n\nhere ", "été  한ᄀ x", "á́ ́b", "Å Ω", ""):
        own, starts, ends = quoting.normal(text)
        assert own == quoting.normal_quote(text) and len(own) == len(starts) == len(ends)
        assert (starts[1:] >= starts[:-1]).all() and (ends[1:] >= ends[:-1]).all()
        if own:
            assert quoting.normal_quote(text[starts[0] : ends[-1]]) == own
