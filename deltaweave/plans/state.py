"""State of incremental operators in the shared folder: logs of segments, merged by levels.

A step appends its change only. Small segments are checkpoints; segments of more than
``LARGE`` bytes, and all segments of a state that must survive the driver, are Parquet tables
partitioned by a hash bucket of the key, so that a step reads the buckets of its keys and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deltaweave.session import cut, empty_frame, known_empty, measured_cut, size_of, use_checkpoints, with_size

#: Measured bytes from which a segment is kept by bucket, and up to which keys are broadcast.
LARGE, SMALL = 64 << 20, 8 << 20
BUCKET = "__b"


@dataclass
class Segment:
    """One part of a log. ``path`` is where a Parquet segment lies; others are checkpoints."""

    frame: DataFrame
    size: int
    path: str | None = None
    buckets: int = 0

    def rows(self) -> DataFrame:
        return self.frame.drop(BUCKET)

    def saved(self) -> dict:
        return {"path": self.path, "size": self.size, "buckets": self.buckets, "schema": self.frame.schema.json()}

    @classmethod
    def load(cls, spark: SparkSession, saved: dict) -> Segment:
        import json

        schema = StructType.fromJson(json.loads(saved["schema"]))
        frame = empty_frame(spark, schema) if saved["path"] is None else spark.read.schema(schema).parquet(saved["path"])
        return cls(frame, saved["size"], saved["path"], saved["buckets"])


def bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.hash(*(F.col(f"`{k}`") for k in keys)), F.lit(buckets)) if keys else F.lit(0)


def write_segment(frame: DataFrame, folder: str, keys: Sequence[str], buckets: int) -> Segment:
    """A Parquet segment by bucket. Rows are rebalanced by bucket, which splits hot ones."""
    spark, path = frame.sparkSession, f"{folder}/{uuid.uuid4().hex}"
    if known_empty(frame):
        return Segment(empty_frame(spark, frame.schema), 0)
    seen, out = with_size(frame)
    placed = out.withColumn(BUCKET, bucket(keys, buckets))
    placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)
    return Segment(spark.read.schema(placed.schema).parquet(path), size_of(seen), path, buckets)


class Segments:
    """State as a log of segments, merged by levels of ``fan`` segments.

    A row is rewritten once a level, so the work of keeping the state follows the changes, not
    the table. Readers take the union of all segments, or of what touches some keys. Segments
    that have been merged away stay until the session's folder goes: frames may still read them.
    """

    def __init__(self, merge: Callable[[DataFrame], DataFrame], keys: Sequence[str] = (), fan: int = 8) -> None:
        self.merge, self.keys, self.fan = merge, list(keys), fan
        self.folder: str | None = None
        self.levels: list[list[Segment]] = [[]]

    def _segment(self, frame: DataFrame, size: int | None = None, at_hand: bool = False) -> Segment:
        spark = frame.sparkSession
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = self.keys or [c for c in frame.columns]
        if self.folder is not None:
            return write_segment(frame, self.folder, keys, buckets)
        if not at_hand:
            frame, size = measured_cut(frame)
        if size > LARGE:
            use_checkpoints(spark)
            return write_segment(frame, f"{spark.sparkContext.getCheckpointDir()}/state", keys, buckets)
        return Segment(frame, size)

    def append(self, change: DataFrame, size: int | None = None) -> None:
        """Add a change; with ``size`` it has been cut before, and is taken as it is."""
        segment = self._segment(change, size, size is not None)
        if segment.size == 0 and known_empty(segment.frame):
            return
        self.levels[0].append(segment)
        k = 0
        while len(self.levels[k]) > self.fan:
            merged = self._segment(self.merge(_union(self.levels[k])))
            self.levels[k] = []
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(merged)
            k += 1

    def held(self) -> list[Segment]:
        return [s for level in self.levels for s in level]

    def all(self) -> DataFrame | None:
        held = self.held()
        return _union(held) if held else None

    def touching(self, known: DataFrame, size: int) -> DataFrame | None:
        """Rows whose keys are among the distinct keys ``known`` (columns in the order of ours,
        nulls being equal). ``size`` is their measured bytes: small ones are broadcast. Of
        segments by bucket only the buckets of the known keys are read.
        """
        held = self.held()
        if not held:
            return None
        if known_empty(known):
            return held[0].rows().where(F.lit(False))
        names = [f"_k{i}" for i in range(len(self.keys))]
        known = known.toDF(*names)
        parts, wanted = [], {}
        for segment in held:
            rows = segment.frame
            if segment.buckets and size <= SMALL:
                if segment.buckets not in wanted:  # at most one integer a bucket
                    wanted[segment.buckets] = [r[0] for r in known.select(bucket(names, segment.buckets)).distinct().collect()]
                rows = rows.where(F.col(BUCKET).isin(wanted[segment.buckets]))
            parts.append(rows.drop(BUCKET))
        return semi_join(reduce(DataFrame.unionByName, parts), self.keys, known, names, size)

    # -- survival ----------------------------------------------------------------------

    def save(self) -> list:
        return [[s.saved() for s in level] for level in self.levels]

    def restore(self, spark: SparkSession, saved: list) -> None:
        self.levels = [[Segment.load(spark, s) for s in level] for level in saved]


def _union(segments: Sequence[Segment]) -> DataFrame:
    return reduce(DataFrame.unionByName, (s.rows() for s in segments))


def semi_join(rows: DataFrame, keys: Sequence[str], known: DataFrame, names: Sequence[str], size: int) -> DataFrame:
    """Rows whose keys (null-safely) are among the known ones; broadcast if measured small."""
    if not keys:
        return rows
    on = reduce(Column.__and__, (rows[f"`{k}`"].eqNullSafe(known[n]) for k, n in zip(keys, names, strict=True)))
    return rows.join(F.broadcast(known) if size <= SMALL else known, on, "left_semi")


class Cell:
    """One table that is replaced as a whole."""

    def __init__(self) -> None:
        self.folder: str | None = None
        self.segment: Segment | None = None

    @property
    def frame(self) -> DataFrame | None:
        return None if self.segment is None else self.segment.rows()

    def put(self, frame: DataFrame) -> DataFrame:
        self.segment = write_segment(frame, self.folder, (), 1) if self.folder is not None else Segment(cut(frame), 0)
        return self.frame

    def clear(self) -> None:
        self.segment = None

    def save(self) -> dict | None:
        return None if self.segment is None else self.segment.saved()

    def restore(self, spark: SparkSession, saved: dict | None) -> None:
        self.segment = None if saved is None else Segment.load(spark, saved)
