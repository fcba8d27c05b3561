"""Long batch runs that can be stopped at any moment and resumed to the same output."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources import files


def run_batch(questions: DataFrame, manifest: dict, work: Callable[[DataFrame], DataFrame], path: str, *, key: str = "question_id", resume: bool = False, portions: int = 8) -> DataFrame:
    """work's results for all questions, in a folder that appears when all are done; what it has already done is kept.

    Questions are dealt over portions, which a stream hands on one after another; each portion's questions that have no
    result yet go through work, whose rows carry the question's key, one each. Results gather in path + ".inprogress" beside
    the manifest. A run that finds such a folder goes on only if it is told to resume, if the manifest is the same, and if
    results are for questions of this batch alone; the stream's own checkpoint then tells which portions are done, and
    results of a portion that was cut off count, too. At the end the results are counted and the folder is renamed.

    A null or repeated key, a result without a question and a question without one result each fail. A finished run is never
    overwritten. Without questions there is an empty result.
    """
    spark, path = questions.sparkSession, path.rstrip("/")
    if path.endswith(".inprogress"):
        raise ValueError("path must name a finished run, not one .inprogress")
    if files.exists(spark, path):
        raise FileExistsError(f"finished: {path}")
    place = f"{path}.inprogress"
    results = f"{place}/results"
    begun = files.exists(spark, f"{place}/manifest.json")
    if begun and not resume:
        raise FileExistsError(f"an unfinished run exists: {place}")
    if resume and not begun:
        raise FileNotFoundError(f"no unfinished run: {place}")
    whole = questions.groupBy(key).agg(F.count("*").alias("n"))
    wrong = whole.where(F.col(key).isNull() | (F.col("n") > 1)).limit(1).collect()
    if wrong:
        raise ValueError(f"null or repeated {key}: {wrong[0][0]!r}")
    if not begun and not files.claim(spark, f"{place}/manifest.json", manifest):
        raise FileExistsError(f"another run has just begun: {place}")
    if files.read_json(spark, f"{place}/manifest.json") != json.loads(json.dumps(manifest)):
        raise ValueError("the unfinished run has another manifest")
    if not files.exists(spark, f"{place}/questions"):
        files.delete(spark, f"{place}/questions.part")
        questions.repartition(portions, key).write.parquet(f"{place}/questions.part")
        files.rename(spark, f"{place}/questions.part", f"{place}/questions")
    asked = spark.read.schema(questions.schema).parquet(f"{place}/questions")

    def done(schema) -> DataFrame:
        return spark.read.schema(schema).parquet(results)

    if files.exists(spark, results):
        outside = done(asked.select(key).schema).join(questions.select(key), key, "left_anti").limit(1).collect()
        if outside:
            raise ValueError(f"an unfinished result is for a question outside this batch: {outside[0][0]!r}")

    def portion(batch: DataFrame, _: int) -> None:
        todo = batch
        if files.exists(spark, results):
            todo = batch.join(done(asked.select(key).schema).select(key), key, "left_anti").select(batch.columns)
        work(todo).write.mode("append").parquet(results)

    stream = spark.readStream.schema(questions.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/questions")
    query = stream.writeStream.foreachBatch(portion).option("checkpointLocation", f"{place}/portions").trigger(availableNow=True).start()
    query.awaitTermination()
    if not files.exists(spark, results):
        work(asked.limit(0)).write.parquet(results)
    checked = spark.read.parquet(results).select(F.col(key), F.lit(1).alias("r"), F.lit(0).alias("q")).unionByName(asked.select(F.col(key), F.lit(0).alias("r"), F.lit(1).alias("q")))
    off = checked.groupBy(key).agg(F.sum("r").alias("r"), F.sum("q").alias("q")).where("r <> 1 OR q <> 1").limit(1).collect()
    if off:
        raise ValueError(f"{off[0].r} results for {off[0].q} questions of {key} {off[0][0]!r}")
    files.rename(spark, results, path)
    files.delete(spark, place)
    return spark.read.parquet(path)
