"""Readers and sinks of JSON lines."""

import pytest

from lodestone.sources import corpus, jsonl

SCHEMA = "id int, text string"


def test_tolerant_reader_keeps_broken_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1, "text": "x"}\n\n{"id": 2}\n[1]\n{"id": 3, "te', encoding="utf-8")
    rows, broken = jsonl.read_tolerant(spark, str(path), SCHEMA)
    assert sorted(map(tuple, rows.collect()), key=str) == [(1, "x"), (2, None)]
    assert {r[0] for r in broken.collect()} == {"[1]", '{"id": 3, "te'}


def test_strict_reader_fails_on_a_broken_line(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1}\n\n{"id": "x"\n', encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_strict(spark, str(path), SCHEMA).collect()


def test_sink_refuses_to_overwrite_and_keys_are_counted(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], SCHEMA)
    jsonl.write_new(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, jsonl.read_strict(spark, str(tmp_path / "out"), SCHEMA).collect()), key=str) == sorted([(1, "a"), (1, "b"), (2, None)], key=str)
    with pytest.raises(FileExistsError):
        jsonl.write_new(rows, str(tmp_path / "out"))
    assert [tuple(r) for r in jsonl.repeated_keys(rows, "id").collect()] == [(1, 2)]


def test_torn_end_is_left_out_and_other_breaks_fail(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1, "text": "x"}\n{"id": 2}\n{"id": 3, "te', encoding="utf-8")
    assert sorted(r.id for r in jsonl.read_torn(spark, str(path), SCHEMA).collect()) == [1, 2]
    for text in ('{"id": 1}\n{"id": 3, "te\n', '{"id": 1, "te\n{"id": 2}\n', '[1]\n{"id": 3, "te'):
        path.write_text(text, encoding="utf-8")
        with pytest.raises(ValueError, match="broken line"):
            jsonl.read_torn(spark, str(path), SCHEMA)


def test_arrays_and_csv_cells(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('[{"n": 1, "k": "b"}, {"n": 0, "k": "a"}]')
    bad.write_text('[{"n": 1, "k": "b"}, {"n": 2, "k": "a"}]')
    assert jsonl.read_array(spark, str(good), "n int, k string", "n", "k").count() == 2
    with pytest.raises(ValueError, match="count from 0"):
        jsonl.read_array(spark, str(bad), "n int, k string", "n", "k")
    table = tmp_path / "a.csv"
    table.write_text('id,cell\n1,"{""x"": [1, 2]}"\n2,nothing\n3,\n')
    rows = jsonl.read_csv_cells(spark, str(table), "id int, cell string", {"cell": "struct<x: array<int>>"}).orderBy("id").collect()
    assert rows[0].cell.x == [1, 2] and (rows[1].cell is None or rows[1].cell.x is None) and rows[2].cell is None


def test_failed_job_leaves_nothing_and_appends_are_idempotent(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], SCHEMA)
    with pytest.raises(Exception, match="(?i)stop"):
        jsonl.write_new(rows.withColumn("text", F.raise_error(F.lit("stop")).cast("string")), str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []
    jsonl.write_new(rows, str(tmp_path / "out"))
    assert jsonl.append_new(rows, str(tmp_path / "log"), "id") == 2 and jsonl.append_new(rows, str(tmp_path / "log"), "id") == 0


def test_corpus_is_refused_when_it_changed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    path = str(tmp_path / "c")
    made = corpus.write_corpus(rows, path, "id", "text")
    assert made["records"] == 2 and corpus.read_corpus(spark, path, "id", "text").count() == 2
    assert corpus.corpus_hash(rows.orderBy("text"), "id", "text") == corpus.corpus_hash(rows.unionByName(rows).orderBy(rows.id.desc()), "id", "text")
    spark.createDataFrame([(3, "x")], SCHEMA).write.mode("append").parquet(path + "/records")
    with pytest.raises(ValueError, match="manifest"):
        corpus.read_corpus(spark, path, "id", "text")


def test_vectors_views_and_reports(spark, tmp_path):
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<double>")
    corpus.write_vectors(vectors, str(tmp_path / "v"), "id", "v")
    assert [(r.id, [round(x, 4) for x in r.vector]) for r in corpus.read_vectors(spark, str(tmp_path / "v")).collect()] == [(1, [0.6, 0.8])]
    view, records = spark.createDataFrame([(1, "old"), (2, "same"), (9, "gone")], SCHEMA), spark.createDataFrame([(1, "new"), (2, "same")], SCHEMA)
    assert {(r.id, r.text, r.stale) for r in corpus.rebound(view, records, "id", "text").collect()} == {(1, "new", True), (2, "same", False)}
    assert corpus.write_report(spark.createDataFrame([(1, None)], SCHEMA), str(tmp_path / "r")) == "| id | text |\n| - | - |\n| 1 |  |"
