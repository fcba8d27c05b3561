"""A store of event streams to which batches are appended once, whoever writes and however often.

A batch's rows are written to a folder of their own. The batch counts from the moment at which a file with the next version
is created beside them, which one writer alone can do: another that wanted the same version reads what has been added and
numbers its rows anew. So streams have no gaps and no doubles, and what a lost writer leaves is read by nobody.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.running import running_total
from lodestone.sources import files

#: Values that the store gives, and the time, aren't part of what makes two events the same.
GIVEN = ("stream_version", "state_version_before")


class Conflict(ValueError):
    """An event or attempt came again with other values."""


class EventStore:
    """Streams of events in a folder: each event once, with versions from 1 that have no gaps within its stream.

    stream: the stream's columns. event: the event's id. attempt: a column whose value, where it isn't null, may stand
    once in a stream too, as an answer that is sent again under a new event id. loose: columns that may differ when an
    event comes again, such as the time. No column is called stream_version or state_version_before.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, *, stream: list[str], event: str = "event_id", attempt: str | None = None, loose: tuple[str, ...] = ("created_at",)) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.stream, self.event, self.attempt, self.loose = stream, event, attempt, loose
        self.stored = T.StructType([*self.schema.fields, *[T.StructField(c, T.LongType()) for c in GIVEN]])
        if set(GIVEN) & set(self.schema.names):
            raise ValueError(f"the store gives {GIVEN} itself")

    def version(self) -> int:
        """How many batches count."""
        return len(self._log())

    def _log(self) -> list[str]:
        return [n for n in files.listed(self.spark, f"{self.path}/log") if n.endswith(".json")]

    def read(self, version: int | None = None) -> DataFrame:
        """All events that count, as of a version if one is named."""
        folders = [files.read_json(self.spark, f"{self.path}/log/{name}")["folder"] for name in self._log()[:version]]
        reader = self.spark.read.schema(self.stored)
        return reader.parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.stored)

    def append(self, events: DataFrame, *order: str) -> int:
        """Adds the events that aren't stored yet, in the order of some columns and then of their ids; how many those are.

        An event, or an attempt, that is stored already or comes twice in the batch is taken once; if its values differ,
        but for the time and, with an attempt, for the event's id, nothing is added and the call fails. Null ids fail. Other
        writers may append at the same time. A stream's versions are counted by ranges of its events, so no task holds a
        stream.
        """
        events = events.select(*[F.col(c).cast(t.dataType).alias(c) for c, t in zip(self.schema.names, self.schema.fields)])
        while True:
            version = self.version()
            folder = f"v{version + 1:020d}-{uuid.uuid4().hex}"
            try:
                n = self._write(events, version, [*order, self.event], f"{self.path}/data/{folder}")
            except BaseException:
                files.delete(self.spark, f"{self.path}/data/{folder}")
                raise
            if n and not files.claim(self.spark, f"{self.path}/log/{version + 1:020d}.json", {"folder": folder, "rows": n}):
                files.delete(self.spark, f"{self.path}/data/{folder}")
                continue
            if not n:
                files.delete(self.spark, f"{self.path}/data/{folder}")
            return n

    def _write(self, events: DataFrame, version: int, order: list[str], folder: str) -> int:
        old = self.read(version)
        key, place = F.struct(*order), F.struct(F.lit(1).alias("new"), F.struct(*order).alias("at"))
        both = old.select(*self.schema.names, F.struct(F.lit(0).alias("new"), key.alias("at")).alias("place")).unionByName(events.select(*self.schema.names, place.alias("place")))
        # one row for each event, the first; then one for each attempt
        once = self._once(both, [self.event], self.loose)
        if self.attempt:
            has = F.col(self.attempt).isNotNull()
            again = self._once(once.where(has), [*self.stream, self.attempt], (*self.loose, self.event))
            once = again.unionByName(once.where(~has))
        fresh = once.where("place.new = 1").drop("place")
        rows = numbered(fresh, self.stream, order, old.groupBy(*self.stream).agg(F.max("stream_version").alias("known")))
        rows.select(*self.stored.names).write.parquet(folder)
        return self.spark.read.schema(self.stored).parquet(folder).count()

    def _once(self, rows: DataFrame, key: list[str], loose: tuple[str, ...]) -> DataFrame:
        """The first row of each key, with the check that all others are alike in what isn't loose."""
        own = F.struct(*[F.col(c) for c in self.schema.names if c not in loose])
        first = F.min_by(F.struct(*self.schema.names), "place").alias("row")
        by = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(first, F.min("place").alias("place"), F.min(own).alias("low"), F.max(own).alias("high"))
        nulls = F.greatest(*[F.col(f"__{c}").isNull() for c in key], F.lit(False))
        bad = nulls | ~F.col("low").eqNullSafe(F.col("high"))
        say = F.concat(F.lit("CONFLICT: "), F.to_json(F.struct(*[f"__{c}" for c in key])))
        checked = by.where(F.when(bad, F.raise_error(say).cast("boolean")).otherwise(True))
        return checked.select("row.*", "place")


def numbered(fresh: DataFrame, stream: list[str], order: list[str], known: DataFrame) -> DataFrame:
    """fresh with its versions, which go on from each stream's known ones."""
    rows = running_total(fresh, stream, order, None, "__n")
    known = known.select(*[F.col(c).alias(f"__k_{c}") for c in stream], "known")
    met = rows.join(known, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in stream], "left")
    version = (F.col("__n") + F.coalesce("known", F.lit(0))).cast("long")
    return met.withColumn("stream_version", version).withColumn("state_version_before", version - 1)
