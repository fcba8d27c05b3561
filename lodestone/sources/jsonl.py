"""JSON lines: strict and tolerant readers, unique keys, and a sink that refuses to overwrite."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"


def read_strict(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of JSON lines; a line that isn't an object of the schema's types fails the read. Blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parsed(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[T.StructType, DataFrame]:
    """The schema, and each line that isn't blank (value) with its row and whether it is good."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    read = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    rows = read.select("value", F.from_json("value", T.StructType([*fields.fields, T.StructField(BROKEN, T.StringType())]), options).alias("row"))
    return fields, rows.withColumn("good", F.coalesce(F.col("row").isNotNull() & F.col(f"row.{BROKEN}").isNull(), F.lit(False)))


def read_tolerant(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): rows that parse, and the text of each line that doesn't, so that nothing is lost silently."""
    fields, rows = parsed(spark, path, schema)
    return rows.where("good").select(*[F.col(f"row.`{f.name}`") for f in fields.fields]), rows.where(~F.col("good")).select(F.col("value").alias(BROKEN))


def read_torn(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of one file whose last line may have been cut off while it was written; any other broken line fails the read.

    The torn line is told by what it is: the only broken one, and the end of a file that has no line end.
    """
    fields, rows = parsed(spark, path, schema)
    broken = rows.where(~F.col("good")).select("value").limit(2).collect()
    if len(broken) > 1 or (broken and not torn_end(spark, path, broken[0].value)):
        raise ValueError(f"{path} has a broken line that isn't its unfinished end: {broken[0].value[:100]!r}")
    return rows.where("good").select(*[F.col(f"row.`{f.name}`") for f in fields.fields])


def torn_end(spark: SparkSession, path: str, line: str) -> bool:
    """Whether the file at path ends with this line and no line end. Spark's own file system is asked for the last bytes."""
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    want = line.encode()
    size = system.getFileStatus(file).getLen()
    stream = system.open(file)
    try:
        stream.seek(max(0, size - len(want)))
        return bytes(stream.readAllBytes()) == want
    finally:
        stream.close()


def read_array(spark: SparkSession, path: str, schema: str | T.StructType, position: str, key: str) -> DataFrame:
    """Rows of a JSON array whose column position counts from 0 without gaps and whose key is unique; else the read fails."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    n, distinct, keys, low, high = rows.agg(F.count("*"), F.countDistinct(position), F.countDistinct(key), F.min(position), F.max(position)).head()
    if n and (distinct != n or keys != n or low != 0 or high != n - 1):
        raise ValueError(f"{path}: {position} must count from 0 to {n - 1}, and {key} must be unique")
    return rows


def read_csv_cells(spark: SparkSession, path: str, schema: str | T.StructType, cells: dict[str, str]) -> DataFrame:
    """Rows of a CSV file with a header, some of whose cells hold JSON of the types in cells; a cell that doesn't parse is null."""
    rows = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumns({c: F.from_json(c, kind, {"mode": "PERMISSIVE"}) for c, kind in cells.items()})


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has, with their number of rows; none where the key is unique."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def write_new(rows: DataFrame, path: str) -> None:
    """JSON lines in a new folder that appears whole or not at all; an existing one is never overwritten.

    Rows are written beside it and the folder is renamed at the end, so a job that fails leaves nothing in the way.
    """
    spark, jvm = rows.sparkSession, rows.sparkSession._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    if system.exists(target):
        raise FileExistsError(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.part-{uuid.uuid4().hex}")
    try:
        rows.write.json(beside.toString())
        if not system.rename(beside, target):
            raise FileExistsError(path)
    finally:
        if system.exists(beside):
            system.delete(beside, True)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't stored at path yet, each once; how many those are. A second call adds nothing."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
        fresh = fresh.join(spark.read.schema(rows.schema).json(path).select(key), key, "left_anti").select(rows.columns)
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(path)
    return n
