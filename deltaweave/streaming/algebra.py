"""Streams over logical time: one DataFrame with ``__t`` in 0 .. length-1.

A weighted stream holds ``__t`` and ``__w``; a scalar stream holds ``__t`` and ``value``.
Operators are single plans over all times, so a whole history is processed at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaweave.operators.zframe import Condition, W, ZFrame, as_column

T = "__t"


class ZStream:
    """A stream of weighted tables; past its end it holds the empty table."""

    def __init__(self, df: DataFrame, length: int) -> None:
        self.df, self.length = df, length

    @classmethod
    def of(cls, df: DataFrame, time: Condition, length: int, weight: Column | int = 1) -> ZStream:
        w = F.lit(weight) if isinstance(weight, int) else weight
        return cls(df.withColumn(T, as_column(time).cast("int")).withColumn(W, w.cast("long")), length)

    @classmethod
    def from_steps(cls, steps: list[ZFrame]) -> ZStream:
        frames = [s.df.withColumn(T, F.lit(t)) for t, s in enumerate(steps)]
        return cls(reduce(DataFrame.unionByName, frames), len(steps))

    @classmethod
    def constant(cls, frame: ZFrame, length: int) -> ZStream:
        return cls(frame.df.withColumn(T, F.explode(F.sequence(F.lit(0), F.lit(length - 1)))), length)

    @property
    def rows(self) -> list[str]:
        return [c for c in self.df.columns if c not in (T, W)]

    def at(self, t: int) -> ZFrame:
        return ZFrame(self.df.where(F.col(T) == t).drop(T))

    def steps(self) -> list[ZFrame]:
        return [self.at(t) for t in range(self.length)]

    def consolidate(self) -> ZStream:
        out = self.df.groupBy(T, *(F.col(f"`{c}`") for c in self.rows)).agg(F.sum(W).alias(W)).where(F.col(W) != 0)
        return ZStream(out.select(*(F.col(f"`{c}`") for c in self.df.columns)), self.length)

    # -- pointwise ---------------------------------------------------------------------

    def lift(self, operator: Callable[[DataFrame], DataFrame]) -> ZStream:
        """A linear operator on rows that keeps ``__t`` and ``__w``."""
        return ZStream(operator(self.df), self.length)

    def filter(self, condition: Condition) -> ZStream:
        return self.lift(lambda df: df.where(as_column(condition)))

    def map(self, *expressions: Condition) -> ZStream:
        return self.lift(lambda df: df.select(*(as_column(e) for e in expressions), T, W))

    def add(self, other: ZStream) -> ZStream:
        return ZStream(self.df.unionByName(other.df), max(self.length, other.length))

    def negate(self) -> ZStream:
        return self.lift(lambda df: df.withColumn(W, -F.col(W)))

    def subtract(self, other: ZStream) -> ZStream:
        return self.add(other.negate())

    def distinct(self) -> ZStream:
        return ZStream(self.consolidate().df.where(F.col(W) > 0).withColumn(W, F.lit(1).cast("long")), self.length)

    def lift2(self, other: ZStream, operator: Callable[[DataFrame, DataFrame], DataFrame]) -> ZStream:
        """A binary operator that joins on ``__t`` itself; the shorter stream is padded with empty tables."""
        return ZStream(operator(self.df, other.df), max(self.length, other.length))

    def aggregate(self, *aggregates: Column) -> DataFrame:
        """Aggregates a time (times without rows are absent)."""
        return self.df.groupBy(T).agg(*aggregates)

    # -- time --------------------------------------------------------------------------

    def delay(self) -> ZStream:
        """One step later; the first step is empty and the stream one longer."""
        return ZStream(self.df.withColumn(T, F.col(T) + 1), self.length + 1)

    def integrate(self) -> ZStream:
        """Running sum. A row is summed once a time first and then runs on over the times at
        which some change of it occurs, as intervals, before it is unfolded."""
        changes = self.consolidate().df
        over = Window.partitionBy(*(F.col(f"`{c}`") for c in self.rows)).orderBy(T)
        spans = changes.withColumn("_until", F.coalesce(F.lead(T).over(over) - 1, F.lit(self.length - 1))).withColumn(W, F.sum(W).over(over.rowsBetween(Window.unboundedPreceding, 0)))
        unfolded = spans.where(F.col(W) != 0).withColumn(T, F.explode(F.sequence(F.col(T), F.col("_until")))).drop("_until")
        return ZStream(unfolded.select(*(F.col(f"`{c}`") for c in self.df.columns)), self.length)

    def differentiate(self) -> ZStream:
        """Each step minus the one before."""
        shifted = ZStream(self.delay().df.where(F.col(T) < self.length), self.length)
        return self.subtract(shifted).consolidate()

    def incrementalize(self, query: Callable[[ZStream], ZStream]) -> ZStream:
        """``D(Q(I(self)))``: the incremental form of any query that keeps ``__t``."""
        return query(self.integrate()).differentiate()


class ScalarStream:
    """A stream of numbers ``__t, value``; absent times hold zero."""

    def __init__(self, df: DataFrame, length: int) -> None:
        self.length = length
        times = df.sparkSession.range(length).select(F.col("id").cast("int").alias(T))
        self.df = times.join(df.groupBy(T).agg(F.sum("value").alias("value")), T, "left").select(T, F.coalesce("value", F.lit(0)).alias("value"))

    # numbers of a stream are few (one a step): one window over them is small

    def integrate(self) -> ScalarStream:
        return ScalarStream(self.df.withColumn("value", F.sum("value").over(Window.orderBy(T))), self.length)

    def differentiate(self) -> ScalarStream:
        return ScalarStream(self.df.withColumn("value", F.col("value") - F.lag("value", 1, 0).over(Window.orderBy(T))), self.length)

    def delay(self) -> ScalarStream:
        return ScalarStream(self.df.withColumn(T, F.col(T) + 1), self.length + 1)

    def lift2(self, other: ScalarStream, combine: Callable[[Column, Column], Column]) -> ScalarStream:
        length = max(self.length, other.length)
        a, b = ScalarStream(self.df, length).df.withColumnRenamed("value", "_a"), ScalarStream(other.df, length).df.withColumnRenamed("value", "_b")
        return ScalarStream(a.join(b, T).select(T, combine(F.col("_a"), F.col("_b")).alias("value")), length)


def compose(*operators: Callable) -> Callable:
    """The operators applied from left to right."""
    return lambda stream: reduce(lambda s, op: op(s), operators, stream)
