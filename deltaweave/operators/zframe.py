"""Weighted tables: a DataFrame whose rows carry a signed multiplicity.

A row's identity is the whole row, compared null-safely. Methods are lazy and return new
frames; only those that say so run a job. Frames need not be consolidated: a row may occur
several times, and its weight is then the sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deltaweave.session import empty_frame

#: The weight column. It is part of every frame and of no user schema.
W = "__w"

Condition = Column | str


def as_column(value: Condition) -> Column:
    return F.expr(value) if isinstance(value, str) else value


class ZFrame:
    """A weighted table over ``df``, which has a long column ``__w``."""

    def __init__(self, df: DataFrame) -> None:
        if W not in df.columns:
            raise ValueError(f"a weighted table needs a column {W}")
        self.df = df

    # -- construction ------------------------------------------------------------------

    @classmethod
    def of(cls, df: DataFrame, weight: Column | int = 1) -> ZFrame:
        """Every row of a plain table with one weight (duplicates add up)."""
        return cls(df.withColumn(W, (F.lit(weight) if isinstance(weight, int) else weight).cast("long")))

    @classmethod
    def from_entries(cls, spark: SparkSession, entries: Iterable[tuple[Sequence, int]], schema: StructType | str) -> ZFrame:
        """(row, weight) pairs; zero weights vanish and equal rows merge."""
        plain = spark.createDataFrame([], schema).schema
        rows = [(*row, int(weight)) for row, weight in entries]
        return cls(spark.createDataFrame(rows, StructType([*plain.fields, *spark.createDataFrame([], f"{W} long").schema.fields]))).consolidate()

    @classmethod
    def from_values(cls, spark: SparkSession, rows: Iterable[Sequence], schema: StructType | str) -> ZFrame:
        return cls.from_entries(spark, ((r, 1) for r in rows), schema)

    @classmethod
    def zero(cls, spark: SparkSession, schema: StructType | str) -> ZFrame:
        return cls.of(empty_frame(spark, schema))

    def empty(self) -> ZFrame:
        """The empty table of this schema."""
        return ZFrame(empty_frame(self.df.sparkSession, self.df.schema))

    # -- access ------------------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != W]

    @property
    def schema(self) -> StructType:
        return StructType([f for f in self.df.schema.fields if f.name != W])

    def cols(self) -> list[Column]:
        return [F.col(f"`{c}`") for c in self.columns]

    def entries(self, weight_name: str = "weight") -> DataFrame:
        """Distinct rows with their weight under a plain name."""
        return self.consolidate().df.withColumnRenamed(W, weight_name)

    def values(self) -> DataFrame:
        """Distinct rows whose weight is not zero, without the weight."""
        return self.consolidate().df.drop(W)

    def bag(self) -> DataFrame:
        """A plain table with each row as often as its (positive) weight."""
        return self.consolidate().df.where(F.col(W) > 0).withColumn(W, F.explode(F.sequence(F.lit(1).cast("long"), F.col(W)))).drop(W)

    def has(self, condition: Condition) -> bool:
        """Runs a job: whether a row that meets the condition has a weight."""
        return not self.filter(condition).consolidate().df.isEmpty()

    def weight(self, condition: Condition) -> int:
        """Runs a job: total weight of the rows that meet the condition."""
        return self.filter(condition).df.agg(F.coalesce(F.sum(W), F.lit(0))).first()[0]

    def size(self) -> int:
        """Runs a job: number of distinct rows."""
        return self.consolidate().df.count()

    def is_zero(self) -> bool:
        """Runs a job."""
        return self.consolidate().df.isEmpty()

    def is_set(self) -> bool:
        """Runs a job: every row weighs one."""
        return self.consolidate().df.where(F.col(W) != 1).isEmpty()

    def is_positive(self) -> bool:
        """Runs a job: no row weighs less than one."""
        return self.consolidate().df.where(F.col(W) < 0).isEmpty()

    def equals(self, other: ZFrame) -> bool:
        """Runs a job: the same rows with the same weights."""
        return self.subtract(other).is_zero()

    # -- group -------------------------------------------------------------------------

    def consolidate(self) -> ZFrame:
        """One row each, none of weight zero. Weights are summed map-side first."""
        return ZFrame(self.df.groupBy(*self.cols()).agg(F.sum(W).alias(W)).where(F.col(W) != 0).select(*(F.col(f"`{c}`") for c in self.df.columns)))

    def add(self, other: ZFrame) -> ZFrame:
        return ZFrame(self.df.unionByName(other.df))

    def negate(self) -> ZFrame:
        return ZFrame(self.df.withColumn(W, -F.col(W)))

    def subtract(self, other: ZFrame) -> ZFrame:
        """Weights may become negative; the positive part is SQL's EXCEPT ALL."""
        return self.add(other.negate())

    def insert(self, rows: DataFrame, weight: int = 1) -> ZFrame:
        return self.add(ZFrame.of(rows, weight))

    def distinct(self) -> ZFrame:
        """Rows of positive weight, once each."""
        return ZFrame(self.consolidate().df.where(F.col(W) > 0).withColumn(W, F.lit(1).cast("long")))

    def intersect(self, other: ZFrame) -> ZFrame:
        """Bag intersection: the smaller of two positive weights."""
        left = self.consolidate().df.where(F.col(W) > 0).withColumnRenamed(W, "_l")
        right = other.consolidate().df.where(F.col(W) > 0).withColumnRenamed(W, "_r")
        both = left.withColumn("_r", F.lit(0).cast("long")).unionByName(right.withColumn("_l", F.lit(0).cast("long")))
        merged = both.groupBy(*self.cols()).agg(F.least(F.sum("_l"), F.sum("_r")).alias(W))
        return ZFrame(merged.where(F.col(W) > 0))

    # -- linear ------------------------------------------------------------------------

    def filter(self, condition: Condition) -> ZFrame:
        return ZFrame(self.df.where(as_column(condition)))

    def map(self, *expressions: Condition) -> ZFrame:
        """New columns from each row; rows that become equal add up."""
        return ZFrame(self.df.select(*(as_column(e) for e in expressions), F.col(W)))

    def flat_map(self, items: Condition, name: str, *keep: Condition) -> ZFrame:
        """One row for each element of an array expression, each with its row's weight."""
        return ZFrame(self.df.select(*(as_column(k) for k in keep), F.explode(as_column(items)).alias(name), F.col(W)))

    def map_batches(self, function: Callable, schema: str) -> ZFrame:
        """Arrow batches through a Python function; its schema must carry ``__w``."""
        return ZFrame(self.df.mapInPandas(function, schema))

    def transform(self, *steps: Callable[[ZFrame], ZFrame]) -> ZFrame:
        """The steps in order."""
        out = self
        for step in steps:
            out = step(out)
        return out

    # -- aggregates --------------------------------------------------------------------

    def count(self) -> DataFrame:
        """Total weight as ``count`` (0 for the empty table)."""
        return self.df.agg(F.coalesce(F.sum(W), F.lit(0)).cast("long").alias("count"))

    def sum(self, expression: Condition, name: str = "sum") -> DataFrame:
        """Weighted sum (null without a non-null value)."""
        return self.df.agg(F.sum(weighed(self.df, expression)).alias(name))

    def reduce(self, *aggregates: Column) -> DataFrame:
        """Any aggregate expressions over rows and ``__w``."""
        return self.df.agg(*aggregates)


def weighed(df: DataFrame, expression: Condition) -> Column:
    """An expression over ``df`` times the weight. A decimal keeps its scale: the product with a
    long would have over 38 digits from a precision of 18 on, and Spark takes those off the scale."""
    e = as_column(expression)
    kind = df.select(e.alias("e")).schema["e"].dataType
    if kind.typeName() != "decimal" or kind.precision > 28:
        return e * F.col(W)
    digits = min(19, 37 - kind.precision)
    exact = (e * F.col(W).cast(f"decimal({digits},0)")).cast(f"decimal(38,{kind.scale})")
    if digits == 19:  # every long
        return exact
    small = F.col(W).between(1 - 10**digits, 10**digits - 1)
    return F.when(small, exact).otherwise((e * F.col(W)).cast(f"decimal(38,{kind.scale})"))


def weighted_sum(expression: Condition) -> Column:
    return F.sum(as_column(expression) * F.col(W))


def weighted_count(expression: Condition | None = None) -> Column:
    """Weight of all rows, or of those where the expression is not null."""
    weight = F.col(W) if expression is None else F.when(as_column(expression).isNotNull(), F.col(W))
    return F.coalesce(F.sum(weight), F.lit(0)).cast("long")


def weighted_avg(expression: Condition) -> Column:
    n = weighted_count(expression)
    return F.when(n != 0, weighted_sum(expression).cast("double") / n)


def weighted_min(expression: Condition) -> Column:
    """Over rows of positive weight; consolidate first if weights of a row may differ in sign."""
    return F.min(F.when(F.col(W) > 0, as_column(expression)))


def weighted_max(expression: Condition) -> Column:
    return F.max(F.when(F.col(W) > 0, as_column(expression)))
