"""Feeds and files: streams over folders of files, load generation, and dumps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files_a_batch: int | None = None, **options: str) -> DataFrame:
    """New files of a folder as a stream; ``files_a_batch`` bounds a micro-batch."""
    reader = spark.readStream.format(kind).schema(schema).options(**options)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.load(path)


def change_feed(spark: SparkSession, path: str, row_schema: str, files_a_batch: int | None = None) -> DataFrame:
    """JSON change messages ``op, seq`` and a nested ``row`` as flat changes."""
    feed = file_stream(spark, path, f"op string, seq long, row struct<{_nested(row_schema)}>", "json", files_a_batch)
    return feed.select("op", "seq", "row.*")


def _nested(schema: str) -> str:
    return ", ".join(": ".join(part.split(None, 1)) for part in schema.split(", "))


def load_stream(spark: SparkSession, rows_a_second: int, *columns: str) -> DataFrame:
    """Generated rows at a rate, with SQL expressions over ``value`` and ``timestamp``."""
    source = spark.readStream.format("rate").option("rowsPerSecond", rows_a_second).load()
    return source.selectExpr("value", "timestamp", *columns)


class Feed:
    """A generated feed of numbered messages under control: a snapshot, then ``rate`` messages a
    tick, with bursts and pauses. ``make`` turns a column ``id`` into messages, so a feed's
    content depends on the numbers alone.
    """

    def __init__(self, make: Callable[[DataFrame], DataFrame], spark: SparkSession, rate: int = 100) -> None:
        self.make, self.spark, self.rate = make, spark, rate
        self.sent, self.extra, self.paused = 0, 0, False

    def _next(self, count: int) -> DataFrame:
        first, self.sent = self.sent, self.sent + count
        return self.make(self.spark.range(first, self.sent))

    def snapshot(self, count: int) -> DataFrame:
        return self._next(count)

    def tick(self) -> DataFrame:
        """The next messages; none while the feed is paused."""
        if self.paused:
            return self._next(0)
        count, self.extra = self.rate + self.extra, 0
        return self._next(count)

    def burst(self, count: int) -> None:
        """So many more messages with the next tick."""
        self.extra += count

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False


def dump(df: DataFrame, path: str, kind: str = "json", partition_by: list[str] | None = None) -> None:
    """Write a table as a folder of files."""
    writer = df.write.mode("overwrite").format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def load(spark: SparkSession, path: str, schema: StructType | str, kind: str = "json") -> DataFrame:
    return spark.read.format(kind).schema(schema).load(path)


def snapshot_then_changes(snapshot: DataFrame, changes: DataFrame, op: str = "op", seq: str = "seq") -> DataFrame:
    """A snapshot as inserts before all changes, in the form of one change log."""
    first = changes.agg(F.coalesce(F.min(seq), F.lit(1)).alias("_first"))
    inserts = snapshot.crossJoin(F.broadcast(first)).select(F.lit("insert").alias(op), (F.col("_first") - 1).alias(seq), *snapshot.columns)
    return inserts.unionByName(changes.select(op, seq, *snapshot.columns))
