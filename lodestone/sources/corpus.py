"""A corpus on disk: records with a manifest of counts and hashes, vectors, and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.jsonl import write_new


def corpus_hash(records: DataFrame, *columns: str) -> str:
    """A hash of the set of distinct values of columns, whatever their order: of a sum of their hashes and their number."""
    each = records.select(*columns).distinct().select(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    row = each.agg(F.count("*"), *map(part, range(5))).head()
    import hashlib

    return "sha256:" + hashlib.sha256("|".join(str(x or 0) for x in row).encode()).hexdigest()


def manifest(records: DataFrame, doc: str, text: str) -> dict:
    """Counts by document and the hash of all records."""
    counts = records.agg(F.count("*"), F.countDistinct(doc)).head()
    return {"records": counts[0], "documents": counts[1], "hash": corpus_hash(records, doc, text)}


def write_corpus(records: DataFrame, path: str, doc: str, text: str) -> dict:
    """Records as Parquet in a new folder, and their manifest beside them."""
    spark = records.sparkSession
    records.write.mode("errorifexists").parquet(f"{path}/records")
    made = manifest(spark.read.parquet(f"{path}/records"), doc, text)
    write_new(spark.createDataFrame([(json.dumps(made, sort_keys=True),)], "manifest string"), f"{path}/manifest")
    return made


def read_corpus(spark: SparkSession, path: str, doc: str, text: str) -> DataFrame:
    """Records of a folder, refused if they aren't those that the manifest tells of."""
    records = spark.read.parquet(f"{path}/records")
    told = json.loads(spark.read.schema("manifest string").json(f"{path}/manifest").head()[0])
    if told != (found := manifest(records, doc, text)):
        raise ValueError(f"{path}: the manifest says {told}, the records {found}")
    return records


def write_vectors(vectors: DataFrame, path: str, id_col: str, vector_col: str) -> None:
    """Vectors of length 1 as (id, vector of float), for search by inner product; those without a length are left out."""
    vec = F.col(vector_col).cast("array<double>")
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(F.col(id_col).alias("id"), vec.alias("vec"), length.alias("length")).where("length > 0 and not isnan(length) and length < double('infinity')")
    rows.select("id", F.transform("vec", lambda x: x / F.col("length")).cast("array<float>").alias("vector")).write.mode("errorifexists").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, vector array<float>").parquet(path)


def rebound(view: DataFrame, records: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """An older view's rows bound to records by id, with the records' hashes in place of its own; stale tells which hashes changed."""
    now = records.select(id_col, F.col(hash_col).alias("__now"))
    out = view.join(now, id_col, "inner").withColumn("stale", ~F.col(hash_col).eqNullSafe(F.col("__now")))
    return out.withColumn(hash_col, F.col("__now")).drop("__now")


def write_report(rows: DataFrame, path: str, *, limit: int = 1000) -> str:
    """A report's rows as CSV and JSON in new folders, and as a Markdown table, which is for reports of limit rows at most."""
    rows.write.mode("errorifexists").option("header", True).csv(f"{path}/csv")
    write_new(rows, f"{path}/json")
    told = rows.limit(limit + 1).collect()
    if len(told) > limit:
        raise ValueError(f"a report of more than {limit} rows isn't one to read as a table")
    line = lambda values: "| " + " | ".join("" if v is None else str(v) for v in values) + " |"
    return "\n".join([line(rows.columns), line("-" for _ in rows.columns), *map(line, told)])
