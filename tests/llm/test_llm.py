"""The training-data operators against brute force, on the smallest tables and on small hand-made cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontamination, embeddings, jaccard, language, lines, packing, queries, scoring, substrings, tokens, toxicity

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def hard(spark):
    """Nulls, empty and long texts, repeated rows and ids."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "one"), (None, "a b c d e"), (5, long), (6, long), (7, "日本 é\n\nx")], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents():
    return oracle.connection(SF).execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert oracle.differences(queries.QUERIES[name](spark, SF), oracle.connection(SF), queries.ORACLE_SQL[name]) == ""


def test_token_counts_are_the_librarys_and_cached(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    special = [(100, "x <|endoftext|>y"), (101, "  two  spaces   "), (102, "it's\r\nfine")]
    docs = hard(spark).unionByName(spark.createDataFrame(special, DOCS))
    cache = str(tmp_path / "cache")
    got = Counter(map(tuple, tokens.count_tokens(docs, path, cache).select("doc_id", "n_tokens").collect()))
    assert got == Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in docs.collect())
    n = spark.read.parquet(cache).count()
    assert n == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    tokens.count_tokens(docs, path, cache)
    assert spark.read.parquet(cache).count() == n
    assert tokens.count_tokens(empty(spark), path, cache).count() == 0


def test_packing_is_gapless_and_exact(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    docs = hard(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(docs, path).collect()
    for i, text in docs.collect():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = b"".join(bytes(r.ids) for r in own)
        assert np.frombuffer(ids, "<u4").tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert all(r.length == len(r.ids) // 4 <= 2048 for r in own) and [r.start for r in own] == [2048 * k for k in range(len(own))]
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty(spark), path).count() == 0


def test_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n)[0] for n in (6, 7, 5, 5)] == [0, 1, 2, 2]


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    base = np.concatenate([base, base[rng.integers(0, 40, 150)] + rng.normal(scale=0.2, size=(150, 8))])
    x = np.concatenate([base, base[:60] + rng.normal(scale=0.08, size=(60, 8)), base[:5], base[:5] * 3])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0), (903, x[0].tolist(), None), (904, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    old = {k: getattr(embeddings, k) for k in ("CELL", "BLOCK", "MAX_PIVOTS", "MOST_COPIES")}
    found = []
    for sizes in ((2048, 2048, 64, 4), (10, 16, 4, 100), (10, 16, 4, 2)):  # one cell; cells split several times; some left
        for k, v in zip(old, sizes):
            setattr(embeddings, k, v)
        try:
            found.append({r[0]: tuple(r)[1:] for r in embeddings.near_duplicates(df).collect()})
        finally:
            for k, v in old.items():
                setattr(embeddings, k, v)
    f = x.astype(np.float32).astype(float)
    unit = f / np.linalg.norm(f, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(near, False)
    comp = list(range(len(x)))
    for _ in x:
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
    assert {i: (int(near[i].sum()), comp[i], comp[i] == i) for i in range(len(x))} | {i: (0, i, True) for i in range(900, 905)} == found[0] == found[1] == found[2]
    assert any(c > 2 for c, _, _ in found[0].values())


def test_embeddings_are_split_only_where_it_pays(spark, monkeypatch):
    for k, v in (("CELL", 40), ("BLOCK", 64), ("MAX_PIVOTS", 3)):
        monkeypatch.setattr(embeddings, k, v)
    rng = np.random.default_rng(4)
    centres = np.repeat(np.eye(64)[:3], 200, axis=0)
    for x, parts in ((rng.normal(size=(600, 64)), 1), (centres + rng.normal(scale=0.01, size=(600, 64)), 3)):
        rows = [(i, 0, 64, v.tolist(), 1) for i, v in enumerate(x)]
        cells = embeddings.in_cells(spark.createDataFrame(rows, "key long, label int, dim int, vec array<double>, copies long"), 0.2).collect()
        # vectors that are nowhere close together stay one cell; copies of them at borders would outnumber them
        assert (len({r.path for r in cells}) == 1) == (parts == 1) and len(cells) <= 1.5 * len(x)
        assert sorted(r.key for r in cells if r.home) == list(range(600))


def test_embeddings_near_the_cosine_are_compared_in_double_precision():
    far = np.array([1e-9, -1e-9, 1e-4, -1e-4, 1e-12, -1e-12])
    cosine = 0.98 + far
    x = np.zeros((7, 2))
    x[0], x[1:] = (1, 0), np.stack([cosine, np.sqrt(1 - cosine**2)], 1)
    home = np.ones(7, bool)
    got = [np.stack(some) for some in embeddings.hits(x, np.array([0]), np.arange(1, 7), home, 0.98)]
    assert np.concatenate(got, 1)[1].tolist() == [1, 3, 5]
    # two border copies aren't compared, any other two are
    home = np.array([True, True, False, False])
    a, b = (np.concatenate(some).tolist() for some in zip(*embeddings.hits(np.ones((4, 1)), np.array([0, 2]), np.array([1, 3]), home, 0.98)))
    assert {(0, 1), (0, 3), (2, 1)} <= set(zip(a, b))


def test_embeddings_that_share_an_id_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>, label int, `a.b` int, id long"
    rows = [(1, [1.0, 0.0], 0, 1, 2), (1, [0.0, 1.0], 0, 1, 2), (2, [1.0, 0.01], 0, 1, 2), (3, [0.01, 1.0], 0, 1, 2), (4, [0.01, 1.0], 0, 1, 2), (4, None, 0, 1, 2), (None, [1.0, 0.0], 0, 1, 2)]
    got = Counter(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, kind)).collect()))
    assert got == Counter([(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (4, 0, 4, True), (None, 0, None, True)])
    assert embeddings.near_duplicates(spark.createDataFrame([], kind)).count() == 0


def test_decontamination_matches_brute_force(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = oracle.connection(SF).execute("SELECT item_id, text FROM benchmark").fetchall()
    windows = defaultdict(set)
    for i, text in items:
        w = word.findall(lower(text))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    want = {}
    for i, text in documents():
        w, hit, of = word.findall(lower(text)), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in windows:
                    hit.update(range(k, k + size))
                    of |= windows[key]
        want[i] = (len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(map(str, of))).encode()).hexdigest(), bool(hit))
    assert {r[0]: tuple(r)[1:] for r in decontamination.op4_benchmark_decontamination(spark, SF).collect()} == want


def test_decontamination_of_hard_rows_and_blocks(spark):
    docs = hard(spark).unionByName(spark.createDataFrame([(50, "say A, b! now")], DOCS))
    items = spark.createDataFrame([(1, "a b"), (2, None), (3, "..."), (4, "A B")], "item_id long, text string")
    for size in (1 << 20, 64):
        found = {(r.doc_id, r.n_words): sorted(m.item_id for m in r.matches) for r in decontamination.find_matches(docs, items, block_bytes=size).collect()}
        assert found[50, 4] == ["1", "4"] and found[3, 2] == ["1", "4"] and found[1, 0] == []
    assert {r.doc_id for r in decontamination.decontaminate(docs, items).collect()} == {1, 2, 4, 5, 6, 7}
    assert decontamination.find_matches(empty(spark), items).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).count() == docs.count()


def removed_by_hand(rows, window=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w, gone = SPACED.findall(text or ""), set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            gone.update(range(k, k + window)) if key in seen else seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substring_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    made = [(10_000 + i, " ".join(rng.choice(list("ab" if i % 3 else "abcdefgh"), rng.integers(0, 90)))) for i in range(60)]
    rows = [*documents(), *made, (20_000, "x " * 100), (20_001, "x " * 19), (20_002, None), (20_003, "")]
    docs, want = spark.createDataFrame(rows, DOCS), removed_by_hand(rows)
    for sizes in ({}, {"group": 3, "bucket": 50}):  # short prefixes alone, and many groups with lengthened ones
        kept = substrings.without_repeats(docs, **sizes)
        assert {r.doc_id: (r.n_words, sum(s.words for s in r.removed), r.kept_text) for r in kept.collect()} == want


def test_repeats_are_the_trees_deep_nodes(spark):
    passage = " ".join(f"p{i}" for i in range(24))
    docs = spark.createDataFrame([(1, f"a b c {passage} d"), (2, f"e {passage} f g"), (3, "nothing " * 5)], DOCS)
    for sizes in ({}, {"group": 1}):
        rows = substrings.repeats(docs, **sizes).collect()
        assert {r.doc_id for r in rows} == {1} and {r.start for r in rows} == set(range(3, 8))
        assert all(20 <= r.words <= 27 - r.start and (not sizes or r.words == 20) for r in rows)
    assert max(r.words for r in substrings.repeats(docs).collect()) > 20


def test_trees_nodes_are_repeats_with_their_depths():
    rng = np.random.default_rng(9)
    texts = [rng.integers(0, 3, n) for n in (40, 60, 9, 5, 60)] + [np.zeros(30, np.int64)]
    letters, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    at = np.concatenate([np.arange(e - len(t), e - 4) for t, e in zip(texts, ends)])
    end = np.concatenate([np.full(max(0, len(t) - 4), e) for t, e in zip(texts, ends)])
    tree = substrings.Tree(letters, at, end, [at], 5)
    by = defaultdict(list)
    for p, e in zip(at, end):
        by[tuple(letters[p : p + 5])].append(letters[p:e].tolist())
    got = {tuple(letters[at[tree.leaves[h]] :][:5]): d for h, d in zip(tree.head, tree.depths())}
    common = lambda xs: next((i for i, x in enumerate(zip(*xs)) if len(set(x)) > 1), min(map(len, xs)))
    assert got == {k: common(v) for k, v in by.items()} and len(tree.leaves) == len(at)


def test_substring_dedup_of_hard_rows(spark):
    rows = {(r.doc_id, r.n_words): r.kept_text for r in substrings.without_repeats(hard(spark)).collect()}
    assert rows[1, 0] == "" and rows[None, 5] == "a b c d e" and len(rows[5, 30_000].split()) < 2_000 and rows[6, 30_000] == ""
    assert substrings.without_repeats(empty(spark)).count() == 0


def linked_by_hand(rows, k, num, den):
    sets, where, shared = {}, defaultdict(list), Counter()
    for i, text in rows:
        w = SPACED.findall(lower(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        for s in sets[i]:
            shared.update((j, i) for j in where[s])
            where[s].append(i)
    comp = {i: i for i in sets}
    links = [(a, b) for (a, b), c in shared.items() if den * c >= num * (len(sets[a]) + len(sets[b]) - c)]
    while any(comp[a] != comp[b] for a, b in links):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard_matches_brute_force(spark, k, num, den):
    rng = np.random.default_rng(3)
    bases = [[f"w{j}" for j in rng.integers(0, 400, n)] for n in (30, 60, 150, 150)]
    rows = []
    for i in range(120):
        w = list(bases[rng.integers(len(bases))])
        for p in rng.integers(0, len(w), rng.integers(0, 6)):
            w[p] = f"z{rng.integers(50)}"
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, "A b"), (903, "a B"), (904, "a"), (905, "a")]
    df = spark.createDataFrame(rows, DOCS)
    assert {r[0]: tuple(r)[1:] for r in jaccard.jaccard_components(df, k=k, num=num, den=den).collect()} == linked_by_hand(rows, k, num, den)


def test_pairs_that_share_much_are_made_once_and_only_if_they_may_be_similar(spark, monkeypatch):
    rng = np.random.default_rng(5)
    passages = [" ".join(f"p{i}x{j}" for j in range(60)) for i in range(8)]
    own = lambda n: " ".join(f"o{x}" for x in rng.integers(0, 1 << 40, n))
    # families that share a passage of half their words, and pairs alike in all but a few words that no leader joins
    rows = [(i, f"{passages[i % 8]} {own(60)}") for i in range(80)]
    rows += [(100 + i, f"{t} {own(4)}") for i, (_, t) in enumerate(rows[::5])] + [(200 + i, f"{passages[i % 8]} {own(6)}") for i in range(32)]
    rows += [(7, f"{passages[2]} {passages[3]} {own(5)}"), (300, f"{passages[2]} {passages[3]} {own(5)}")]  # two rows share an id
    df, made, checked = spark.createDataFrame(rows, DOCS).repartition(3), spark.sparkContext.accumulator(0), []
    cross, verify = jaccard.cross_pairs, jaccard.verified

    def counted(group, num, den):
        out = cross(group, num, den)
        made.add(out.num_rows)
        return out

    monkeypatch.setattr(jaccard, "cross_pairs", counted)
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *x: (checked.append(pairs.count()), verify(pairs, *x))[1])
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    sets = [(i, {tuple(w[j : j + 4]) for j in range(len(w) - 3)}) for i, t in rows for w in [t.split()]]
    comp = {i: i for i, _ in rows}
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if 100 * len(x & y) >= 85 * len(x | y)]
    while any(comp[a] != comp[b] for a, b in links):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == set(comp.items()) and links
    assert made.value <= 2 * len(links) and sum(checked) <= 2 * len(links) + len(rows)


def test_parities_rule_out_no_similar_pair():
    rng = np.random.default_rng(6)
    for n in (1, 3, 40, 700, 5000):
        common, other = rng.integers(0, 1 << 40, n), rng.integers(1 << 40, 1 << 41, n)
        for cut in (0, n // 10, n // 2, n):
            texts = [" ".join(map(str, common)), " ".join(map(str, [*common[cut:], *other[:cut]]))]
            s = jaccard.Sets(pa.array([*texts, None]), 1)
            x, y = (set(s.hashes[s.ends[i] : s.ends[i + 1]].tolist()) for i in range(2))
            assert np.bitwise_count(s.parities()[0] ^ s.parities()[1]).sum() <= len(x ^ y) and not s.parities()[2].any()


def test_jaccard_of_hard_rows(spark):
    rows = jaccard.jaccard_components(hard(spark)).collect()
    assert len(rows) == 9 and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_line_dedup_of_hard_rows(spark):
    text = "\n".join(f"line {i}" for i in range(40))
    docs = hard(spark).unionByName(spark.createDataFrame([(80, text), (81, "new\n" + text), (81, "new\n" + text)], DOCS))
    rows = {r.doc_id: r for r in lines.deduplicate_lines(docs).collect()}
    assert rows[80].n_removed == 0 and rows[81].n_removed > 20 and rows[81].n_lines == 41
    assert rows[1].kept_text is None and rows[1].n_lines == 0 and rows[2].n_lines == 1
    assert lines.deduplicate_lines(empty(spark)).count() == 0


def runs_by_hand(rows):
    """n_removed and what is kept, by windows of two filled lines; ids are unique."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        ls = text.split("\n")
        at, gone = [k for k, x in enumerate(ls) if re.search(r"[^ \t\n\x0b\f\r]", x)], set()
        for a, b in zip(at, at[1:]):
            key = tuple(ls[a : b + 1])
            gone.update(range(a, b + 1)) if key in seen else seen.add(key)
        out[i] = (len(ls), len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone))
    return out


def test_line_runs_go_whole(spark):
    passage = [f"passage {i} " + "word " * 60 for i in range(5)]
    rows = [*documents(), (90_000, "\n".join(["before", *passage, "after"]))]
    # every part of two lines or more, between lines of its own; blank lines inside
    rows += [(90_001 + 10 * a + n, "\n".join([f"own {a} {n}", *passage[a : a + n], f"end {a} {n}"])) for a in range(5) for n in range(1, 6 - a)]
    rows += [(91_000, "x\n\nhead\n\ntail\n"), (91_001, "y\nhead\n\ntail\n\nz"), (91_002, "head\n\n\ntail"), (91_003, "")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in lines.deduplicate_runs(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == runs_by_hand(rows)
    assert all(got[90_001 + 10 * a + n][1:] == (n, f"own {a} {n}\nend {a} {n}") for a in range(5) for n in range(2, 6 - a))


def test_runs_of_few_lines_go_whole(spark):
    one, two = ["same line"] * 9, ["first line", "second line"] * 5
    rows = [(1, "\n".join(["head", *one, "tail"])), (2, "\n".join(["start", *one[:4], "end"])), (3, "\n".join(["top", *two, "foot"])), (4, "\n".join(["up", *two[:5], "down"]))]
    got = {r.doc_id: r.kept_text for r in lines.deduplicate_runs(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: "head\nsame line\ntail", 2: "start\nend", 3: "top\nfirst line\nsecond line\nfoot", 4: "up\ndown"}


def test_line_runs_of_hard_rows(spark):
    text = "\n".join(f"line {i}" for i in range(40))
    docs = hard(spark).unionByName(spark.createDataFrame([(None, "a\nb"), (80, text), (81, "new\n" + text), (81, "new\n" + text), (81, "a\nb")], DOCS))
    rows = {(r.doc_id, r.text): r for r in lines.deduplicate_runs(docs).collect()}
    assert rows[80, text].n_removed == 0 and rows[81, "new\n" + text].n_removed == 40 and rows[81, "new\n" + text].kept_text == "new"
    assert rows[None, "a\nb"].n_removed == 0 and rows[81, "a\nb"].n_removed == 2
    assert rows[1, None].kept_text is None and rows[1, None].n_lines == 0 and rows[2, ""].n_lines == 1
    assert lines.deduplicate_runs(docs).count() == docs.count() and lines.deduplicate_runs(empty(spark)).count() == 0


def test_pipelines_line_stage_removes_whole_runs(spark):
    docs = spark.createDataFrame([(1, "a 1\nb 2\nc 3", 11), (2, "x\na 1\nb 2\ny", 11)], "doc_id long, text string, n_chars long")
    assert {tuple(r) for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()} == {(1, "a 1\nb 2\nc 3", 11), (2, "x\ny", 3)}


def test_line_runs_plan_is_native(spark):
    plan = lines.op8_line_run_dedup(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_plan_is_native(spark):
    plan = lines.op8_line_dedup(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    common, bad = [f"c{i}" for i in range(60)], ["vile", "rotten", "horrid"]
    rows = []
    for i in range(600):
        w = list(rng.choice(common, 40))
        if i % 4 == 0:
            w[rng.integers(40)] = bad[rng.integers(3)]
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "id long, text string, toxic int")
    out = zlib.crc32
    model = toxicity.train(df, df.where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1), id_col="id")
    score = {r.id: r.score for r in toxicity.score(df, model, id_col="id").collect()}
    held = [r for r in rows if out(str(r[0]).encode()) % 3 == 1]
    assert all((score[i] >= 0.7) == bool(y) for i, _, y in held)
    assert {r.doc_id: r.score for r in toxicity.score(hard(spark), model).collect()}[1] < 0.7
    assert toxicity.score(empty(spark), model).count() == 0
    assert toxicity.train(df.limit(0), df.limit(0), id_col="id") is not None


def sample_of(toxic, ordinary):
    return toxicity.Sample.of(toxicity.pa.array([*toxic, *ordinary]), [True] * len(toxic) + [False] * len(ordinary))


def test_rare_toxic_words_keep_evidence():
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(60)]
    ordinary, toxic = ([" ".join(rng.choice(common, 40)) for _ in range(n)] for n in (200, 60))
    for at, word in ((0, "vile"), (1, "vile"), (2, "vile"), (3, "odd")):
        toxic[at] = f"c{at} {word} {toxic[at]}"
    model = toxicity.fit_ratios(sample_of(toxic, ordinary))
    of = lambda w: float(toxicity.lookup(toxicity.hashed([w.encode()]), model.words, model.word_ratio)[0][0])
    assert of("vile") > 0.5 > of("odd") > 0.1 > abs(of("c1"))
    assert all(0 < toxicity.discount(n) < 1 for n in (np.array([1, 1, 1, 2]), np.array([1, 1]), np.array([2, 2]), np.zeros(0), np.array([1, 2, 5])))


def test_stretches_of_mild_words_are_toxic():
    rng = np.random.default_rng(6)
    common, mild = [f"c{i}" for i in range(80)], [f"m{i}" for i in range(40)]
    rows = []
    for i in range(500):
        w = list(rng.choice(common, 60))
        if i % 4 == 0:
            w[20:26] = rng.choice(mild, 6)
        else:
            for p in (10, 40):
                w[p] = rng.choice(mild)
        rows.append((" ".join(w), i % 4 == 0))
    train, held = rows[:400], rows[400:]
    sample = toxicity.Sample.of(toxicity.pa.array([t for t, _ in train]), [y for _, y in train])
    model, values = toxicity.chosen(sample)
    toxicity.calibrated(model, values, sample.toxic)
    score = toxicity.score_of(model, toxicity.pa.array([t for t, _ in held]))
    assert np.mean((score >= 0.5) == np.array([y for _, y in held])) >= 0.85


def test_language_on_held_out_rows(spark):
    rows = language.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("held_out and length(text) > 30").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang"), per_language=30)
    got = {r.doc_id: r.lang_pred for r in language.identify(hard(spark).unionByName(spark.createDataFrame([(60, "123 !!")], DOCS)), model).collect()}
    assert got[1] == got[2] == got[60] == "und" and got[7] != "und"
    assert {r.lang_pred for r in language.identify(hard(spark), language.Model([], [])).collect()} == {"und"}


def test_scores_match_brute_force_by_both_ways(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    docs = hard(spark)
    listed = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in docs.collect()]
    good = lambda i: i in (3, 5)
    v = t.get_vocab_size()
    pair, word, context = (defaultdict(lambda: [0, 0]) for _ in range(3))
    for i, ids in listed:
        for a, b in zip([v, *ids], ids):
            for table, key in ((pair, (a, b)), (word, b), (context, a)):
                table[key][1] += 1
                table[key][0] += good(i)
    total = [sum(x[m] for x in word.values()) for m in (0, 1)]
    p = lambda m, a, b: (pair[a, b][m] + 16 * (word[b][m] + 0.5) / (total[m] + 0.5 * (v + 1))) / (context[a][m] + 16)
    want = sorted((len(ids), *(sum(-np.log2(p(m, a, b)) for a, b in zip([v, *ids], ids)) / max(1, len(ids)) for m in (0, 1))) for _, ids in listed)
    ids = spark.createDataFrame([(3,), (5,), (5,), (77,), (None,)], "doc_id long")
    for limit in (1 << 20, 1):
        for target in (F.col("doc_id").isin(3, 5), ids):
            rows = scoring.score(docs, target, path, broadcast=limit).collect()
            assert np.allclose(sorted((r.n_tokens, r.target_bits, r.background_bits) for r in rows), want, rtol=0, atol=1e-9)
    assert scoring.score(empty(spark), F.lit(True), path).count() == 0


def test_toxicity_without_evidence_calls_nothing_toxic():
    model = toxicity.calibrated(toxicity.fit_ratios(sample_of(["a b"], ["c d"])), np.ones((3, len(toxicity.LENGTHS))), np.array([True, False, False]))
    assert not model.weights.any() and model.offset == 0.0


def test_kneser_ney_probabilities_and_scores_match_brute_force():
    rng = np.random.default_rng(8)
    toxic, ordinary = ([" ".join(rng.choice([f"w{i}" for i in range(n)], 12)) for _ in range(m)] for n, m in ((9, 25), (14, 40)))
    counts = toxicity.Counts(sample_of(toxic, ordinary))
    word = lambda w: int(toxicity.hashed([w.encode()])[0])
    for settings in (1.0, 50.0):
        unigram, shares, weight = counts.parts(settings)
        for u, n in zip(unigram, shares):
            total = (1 - weight) * np.bincount(counts.at_context, n, len(weight)) + weight * u.sum()
            assert np.allclose(total, 1) and np.isclose(u.sum(), 1)
        # the same by dictionaries: distinct contexts of words, and distinct contexts of bigrams with the word before them
        sides = []
        for texts in (toxic, ordinary):
            trigrams = {(a, b, c) for t in texts for a, b, c in zip(["", "", *t.split()], ["", *t.split()], t.split())}
            pairs = Counter((b, c) for _, b, c in trigrams)
            sides.append((Counter(c for _, c in pairs), pairs, Counter(b for _, b, _ in trigrams)))
        d = [[toxicity.discount(np.array(list(s[i].values()))) for i in (0, 1)] for s in sides]
        shared = Counter()
        for s, (d0, _) in zip(sides, d):
            shared.update({w: min(n, d0) for w, n in s[0].items()})
        own = [{w: max(0, n - d0) for w, n in s[0].items()} for s, (d0, _) in zip(sides, d)]
        rest = 1 - min((sum(o.values()) / (sum(s[0].values()) + 1) for o, s in zip(own, sides)))
        p1 = lambda k, w: (1 - rest) * own[k].get(w, 0) / sum(own[k].values()) + rest * shared[w] / sum(shared.values())
        mass = [Counter() for _ in sides]
        for m, s, (_, d1) in zip(mass, sides, d):
            for (b, _), n in s[1].items():
                m[b] += max(0, n - d1)
        back = lambda b: max(1 - m[b] / (s[2][b] + settings) for m, s in zip(mass, sides))
        p2 = lambda k, b, c: (1 - back(b)) * (max(0, sides[k][1][b, c] - d[k][1]) / mass[k][b] if mass[k][b] and sides[k][1][b, c] else 0) + back(b) * p1(k, c)
        known = sides[0][1].keys() | sides[1][1].keys()
        text = "w1 w3 w3 w8 w2 w13 w0 w5 nowhere w4"
        w = text.split()
        want = [0.0 if c == "nowhere" else np.log(p2(0, b, c) / p2(1, b, c)) if (b, c) in known and b else np.log(p1(0, c) / p1(1, c)) for b, c in zip(["", *w], w)]
        model = counts.smoothed(settings)
        got = toxicity.ratios(model, *toxicity.keys_of(toxicity.pa.array([text])))
        assert word("w1") in set(model.words.tolist()) and np.allclose(got, want, atol=2e-3)
        values = toxicity.compared(model, *toxicity.keys_of(toxicity.pa.array([text, ""])))
        best = [max(np.mean(got[i : i + n]) for i in range(len(w) - n + 1)) if n and n <= len(w) else np.mean(got) for n in toxicity.LENGTHS]
        assert np.allclose(values[0], best) and not values[1].any()


ODD = {"a.b": "string", "id": "long", "n": "long", "sig": "string", "key": "long", "hash": "long", "component": "long", "__text": "string", "__id": "long", "__sliced": "string", "c0": "long", "carried": "string"}


def odd(spark, docs):
    """docs with further columns whose names clash with those that operators use, or hold a dot; some values null."""
    return docs.select("*", *[F.when(F.col("doc_id") > 3, F.lit("7")).cast(kind).alias(name) for name, kind in ODD.items()])


@pytest.mark.parametrize("name", ["tokens", "scores", "matches", "substrings", "jaccard", "toxicity", "lines", "runs", "language", "packing"])
def test_clashing_names_change_nothing(spark, name, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    tox = toxicity.calibrated(toxicity.fit_ratios(sample_of(["a b"], ["c d"])), np.eye(6, len(toxicity.LENGTHS)), np.array([True] * 3 + [False] * 3))
    run = {
        "tokens": lambda d: tokens.count_tokens(d, path, str(tmp_path / "cache")),
        "scores": lambda d: scoring.score(d, F.col("doc_id") == 3, path),
        "matches": lambda d: decontamination.find_matches(d, items),
        "substrings": lambda d: substrings.without_repeats(d),
        "jaccard": lambda d: jaccard.jaccard_components(d),
        "toxicity": lambda d: toxicity.score(d, tox),
        "lines": lambda d: lines.deduplicate_lines(d),
        "runs": lambda d: lines.deduplicate_runs(d),
        "language": lambda d: language.identify(d, language.Model([], [])),
        "packing": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "piece", "start", "length", "ids"),
    }[name]
    assert Counter(map(repr, run(odd(spark, hard(spark))).collect())) == Counter(map(repr, run(hard(spark)).collect()))


def test_pipelines_stages_take_hard_rows_and_odd_names(spark):
    kind = [("lang", "string"), ("source", "string"), ("n_chars", "long")]
    docs = odd(spark, hard(spark)).select("*", *[F.lit(None).cast(t).alias(c) for c, t in kind])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.staged(stage(spark, docs, SF))
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
        # of rows alike, and of the two long texts of one shingle set, the near-duplicate stage keeps one
        assert ids == Counter([1, 2, 3, 4, None, 5, 7] if name == "near_duplicates" else [1, 2, 3, 3, 4, None, 5, 6, 7]), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter([1, 2, 3, 3, 4, None, 5, 6, 7])
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_rows_that_share_an_id_are_kept_by_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a, "x"), (1, a, "x"), (1, b, "y"), (2, a, "z"), (3, None, None), (3, None, None)], "doc_id long, text string, `a.b` string")
    assert Counter((r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()) == Counter([(1, a), (1, b), (3, None), (3, None)])


def test_pipeline_matches_brute_force_and_keeps_clean_documents(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, stages, rows = docs.columns, dict(corpus_pipeline.STAGES), {r.doc_id: r.text for r in docs.collect()}

    def after(name):
        nonlocal docs
        docs = corpus_pipeline.staged(stages[name](spark, docs, SF))
        assert docs.columns == names
        return {r.doc_id: r.text for r in docs.collect()}

    scores = {r.doc_id: r.score for r in toxicity.op7_toxicity(spark, SF).collect()}
    found = after("toxicity")
    assert found == {i: t for i, t in rows.items() if scores[i] < 0.7} and len(found) > 0.8 * len(rows)
    rows = {i: (x[2] if t is not None else None) for (i, t), x in zip(found.items(), map(runs_by_hand(found.items()).get, found))}
    found = after("line_dedup")
    assert found == rows and {r.doc_id: r.n_chars for r in docs.collect()} == {i: len(t) for i, t in rows.items()}
    rows = {i: found[i] for i, (n, c) in linked_by_hand(found.items(), 5, 80, 100).items() if c == i or not n}
    found = after("near_duplicates")
    assert found == rows
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for (text,) in oracle.connection(SF).execute("SELECT text FROM benchmark").fetchall():
        w = word.findall(lower(text))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    dirty = {i for i, t in found.items() for w in [word.findall(lower(t))] if any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}
    rows = {i: t for i, t in found.items() if i not in dirty}
    found = after("decontamination")
    assert found == rows
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = stages["packing"](spark, docs, SF).orderBy("doc_id", "piece").collect()
    got = defaultdict(list)
    for r in packed:
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in rows.items()}
    # no more sequences than the tokens' lower bound and one open bin of each task's end ask for
    total = sum(map(len, got.values()))
    assert len({r.sequence_id for r in packed}) <= 1.1 * -(-total // 2048) + len({r.sequence_id >> 33 for r in packed})
