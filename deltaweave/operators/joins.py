"""Joins of weighted tables. Weights multiply; null keys match nothing.

Semi and anti joins keep the left weights and look at right rows of positive weight. Nothing is
broadcast by hint: Catalyst and the adaptive planner choose by measured size, and split skewed
keys of sort-merge joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from deltaweave.operators.zframe import Condition, W, ZFrame, as_column

Keys = str | Sequence[str]


def key_list(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _sides(left: ZFrame, right: ZFrame, left_keys: list[str], right_keys: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with private names for weights and right keys, and the key condition."""
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"rename columns that both sides have: {sorted(clash)}")
    a, b = left.df.withColumnRenamed(W, "_wl"), right.df.withColumnRenamed(W, "_wr")
    on = F.lit(True)
    for x, y in zip(left_keys, right_keys, strict=True):
        on = on & (a[x] == b[y])
    return a, b, on


def cartesian(left: ZFrame, right: ZFrame) -> ZFrame:
    """All pairs; meant for a right side of a few rows."""
    a, b, _ = _sides(left, right, [], [])
    return ZFrame(a.crossJoin(b).withColumn(W, F.col("_wl") * F.col("_wr")).drop("_wl", "_wr"))


def join(left: ZFrame, right: ZFrame, left_keys: Keys, right_keys: Keys, where: Condition | None = None, select: Sequence[Condition] | None = None) -> ZFrame:
    """Equi-join with an optional residual predicate and projection, in one plan."""
    a, b, on = _sides(left, right, key_list(left_keys), key_list(right_keys))
    out = a.join(b, on, "inner")
    if where is not None:
        out = out.where(as_column(where))
    out = out.withColumn(W, F.col("_wl") * F.col("_wr")).drop("_wl", "_wr")
    return ZFrame(out if select is None else out.select(*(as_column(s) for s in select), W))


def _present(right: ZFrame, right_keys: list[str]) -> DataFrame:
    """Keys that hold a row of positive weight."""
    return right.consolidate().df.where(F.col(W) > 0).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(right_keys))).distinct()


def _filtered(left: ZFrame, right: ZFrame, left_keys: Keys, right_keys: Keys, how: str) -> ZFrame:
    keys = key_list(left_keys)
    known = _present(right, key_list(right_keys))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & (left.df[k] == known[f"_k{i}"])
    return ZFrame(left.df.join(known, on, how))


def semi_join(left: ZFrame, right: ZFrame, left_keys: Keys, right_keys: Keys) -> ZFrame:
    return _filtered(left, right, left_keys, right_keys, "left_semi")


def anti_join(left: ZFrame, right: ZFrame, left_keys: Keys, right_keys: Keys) -> ZFrame:
    return _filtered(left, right, left_keys, right_keys, "left_anti")


def _padded(rows: ZFrame, other: ZFrame) -> DataFrame:
    return rows.df.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema.fields))


def outer_join(left: ZFrame, right: ZFrame, left_keys: Keys, right_keys: Keys, how: str) -> ZFrame:
    """left, right or full: the inner join and the anti joins padded with nulls."""
    inner = join(left, right, left_keys, right_keys)
    out = inner.df
    if how in ("left", "full"):
        out = out.unionByName(_padded(anti_join(left, right, left_keys, right_keys), right))
    if how in ("right", "full"):
        out = out.unionByName(_padded(anti_join(right, left, right_keys, left_keys), left))
    if how not in ("left", "right", "full"):
        raise ValueError(f"unknown outer join {how!r}")
    return ZFrame(out)


def match_counts(left: ZFrame, right: ZFrame, left_keys: Keys, right_keys: Keys) -> DataFrame:
    """Join size without the join: ``pairs`` is the sum over keys of the sides' weights multiplied."""
    a = left.df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key_list(left_keys)))).agg(F.sum(W).alias("_l"))
    b = right.df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key_list(right_keys)))).agg(F.sum(W).alias("_r"))
    return a.join(b, [f"_k{i}" for i in range(len(key_list(left_keys)))]).agg(F.coalesce(F.sum(F.col("_l") * F.col("_r")), F.lit(0)).cast("long").alias("pairs"))


def observed(frame: ZFrame, name: str) -> tuple[ZFrame, Observation]:
    """The same table, and its rows and weight as counted when a job has run over it."""
    seen = Observation(name)
    return ZFrame(frame.df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(W), F.lit(0)).alias("weight"))), seen


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, take: Sequence[str], forward: bool = False, bucket: Condition | None = None) -> DataFrame:
    """Each left row with ``take`` of the right row of its key that is nearest in time, at or
    before it (or at or after it); nulls without one.

    Both sides are united and sorted once a key, and the last right row seen is carried along:
    one shuffle, no range join. ``bucket`` may split a hot key further where the data allow it
    (an expression over both sides' time such that no match crosses buckets). Equal right times
    are resolved by the largest ``take`` values. A null key or time matches nothing on either
    side; left rows with one stay, with nulls, and are not shuffled.
    """
    known = reduce(Column.__and__, (F.col(c).isNotNull() for c in (*keys, left_ts)))
    lone, left = left.where(~known), left.where(known)
    right = right.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in (*keys, right_ts))))
    payload = F.struct(F.col(right_ts).alias("_ts"), *(F.col(c) for c in take))
    a = left.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(left_ts).alias("_at"), F.lit(0 if forward else 1).alias("_side"), F.struct("*").alias("_left"))
    b = right.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(right_ts).alias("_at"), F.lit(1 if forward else 0).alias("_side"), payload.alias("_right"))
    both = a.withColumn("_right", F.lit(None).cast(b.schema["_right"].dataType)).unionByName(b.withColumn("_left", F.lit(None).cast(a.schema["_left"].dataType)))
    parts = [f"_k{i}" for i in range(len(keys))]
    if bucket is not None:
        both = both.withColumn("_bucket", as_column(bucket))
        parts.append("_bucket")
    order = [F.desc("_at"), F.desc("_side"), F.asc("_right")] if forward else [F.asc("_at"), F.asc("_side"), F.asc("_right")]
    seen = F.last("_right", ignorenulls=True).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_match", seen).where(F.col("_left").isNotNull())
    matched = out.select("_left.*", *(F.col("_match").getField(c).alias(c) for c in take))
    return matched.union(lone.select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take)))


def pruned_join(left: DataFrame, right: DataFrame, left_keys: Keys, right_keys: Keys, left_ts: str, right_ts: str, retention: str) -> DataFrame:
    """What a join that forgets old rows has in the end, for rows that came in time order.

    Each side's watermark is its largest time; rows of the other side older than it by more
    than ``retention`` (an SQL interval) and their results are gone.
    """
    keep = F.expr(f"INTERVAL {retention}")
    left_mark = left.agg(F.max(left_ts).alias("_left_mark"))
    right_mark = right.agg(F.max(right_ts).alias("_right_mark"))
    # one-row sides: each is a single aggregate
    a = left.crossJoin(F.broadcast(right_mark)).where(F.col("_right_mark").isNull() | (F.col(left_ts) >= F.col("_right_mark") - keep)).drop("_right_mark")
    b = right.crossJoin(F.broadcast(left_mark)).where(F.col("_left_mark").isNull() | (F.col(right_ts) >= F.col("_left_mark") - keep)).drop("_left_mark")
    on = F.lit(True)
    for x, y in zip(key_list(left_keys), key_list(right_keys), strict=True):
        on = on & (a[x] == b[y])
    return a.join(b, on)
