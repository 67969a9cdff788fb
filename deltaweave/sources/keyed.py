"""Keyed tables: upserts and removals by primary key, turned into deltas; change logs.

The old row is looked up before a delta is made, so an update is the old row with weight -1 and
the new one with +1, both whole. Of several changes of one key in a batch, the last wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deltaweave.operators.joins import Keys, key_list
from deltaweave.operators.zframe import Condition, W, ZFrame, as_column
from deltaweave.session import cut


def last_changes(log: DataFrame, keys: Keys, seq: str) -> DataFrame:
    """The last change of each key by ``seq`` (whole rows; aggregated map-side, no sort)."""
    k = key_list(keys)
    latest = log.groupBy(*k).agg(F.max_by(F.struct("*"), F.col(seq)).alias("_row"))
    return latest.select("_row.*")


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & left[k].eqNullSafe(right[f"_k{i}"])
    return on


class KeyedTable:
    """The current rows by key. Every verb returns the delta that it made."""

    def __init__(self, spark: SparkSession, schema: StructType | str, keys: Keys) -> None:
        self.spark, self.keys = spark, key_list(keys)
        self.rows = spark.createDataFrame([], schema)
        self.changes = 0

    def _known(self, keys: DataFrame) -> DataFrame:
        return keys.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys))).distinct()

    def _replace(self, gone: DataFrame, new: DataFrame | None) -> ZFrame:
        """Take out the rows ``gone`` (whole current rows) and put in ``new``."""
        delta = ZFrame.of(gone.select(*self.rows.columns), -1)
        if new is not None:
            delta = delta.add(ZFrame.of(new.select(*self.rows.columns)))
        delta = ZFrame(cut(delta.consolidate().df))
        self.rows = cut(ZFrame.of(self.rows).add(delta).consolidate().df.drop(W))
        self.changes += 1
        return delta

    def push(self, rows: DataFrame, seq: str | None = None) -> ZFrame:
        """Insert or update by key; of rows with one key the last by ``seq`` counts, or without
        ``seq`` the greatest row."""
        new = last_changes(rows, self.keys, seq) if seq else rows.groupBy(*self.keys).agg(F.max(F.struct(*rows.columns)).alias("_row")).select("_row.*")
        new = cut(new.select(*self.rows.columns))
        known = self._known(new)
        return self._replace(self.rows.join(known, _match(self.rows, known, self.keys), "left_semi"), new)

    upsert = push

    def insert(self, rows: DataFrame) -> ZFrame:
        """Insert; rows whose key exists are an error."""
        known = self._known(rows)
        if not self.rows.join(known, _match(self.rows, known, self.keys), "left_semi").isEmpty():
            raise KeyError("a row with this key exists")
        return self.push(rows)

    def insert_many(self, rows: DataFrame) -> ZFrame:
        """Insert; rows whose key exists are skipped."""
        known = self._known(self.rows)
        return self.push(rows.join(known, _match(rows, known, self.keys), "left_anti"))

    def update(self, condition: Condition, **values: Column) -> ZFrame:
        """New values for the rows that meet the condition."""
        old = self.rows.where(as_column(condition))
        return self._replace(old, old.withColumns(values))

    def remove(self, keys: DataFrame) -> ZFrame:
        known = self._known(keys)
        return self._replace(self.rows.join(known, _match(self.rows, known, self.keys), "left_semi"), None)

    def remove_where(self, condition: Condition) -> ZFrame:
        return self._replace(self.rows.where(as_column(condition)), None)

    def clear(self) -> ZFrame:
        return self._replace(self.rows, None)

    def set_data(self, rows: DataFrame) -> ZFrame:
        """Make the table hold just these rows; rows in common make no delta."""
        return self._replace(self.rows, rows)

    def apply(self, log: DataFrame, op: str = "op", seq: str = "seq") -> ZFrame:
        """A change log with ``op`` insert, update or delete: each key's last change counts."""
        final = cut(last_changes(log, self.keys, seq))
        known = self._known(final)
        return self._replace(self.rows.join(known, _match(self.rows, known, self.keys), "left_semi"), final.where(F.col(op) != "delete"))

    def exists(self, condition: Condition) -> bool:
        return not self.rows.where(as_column(condition)).isEmpty()

    def get(self, condition: Condition):
        return self.rows.where(as_column(condition)).first()

    def stats(self) -> dict[str, int]:
        return {"rows": self.rows.count(), "changes": self.changes}


def current_rows(log: DataFrame, keys: Keys, op: str, seq: str) -> DataFrame:
    """What a change log leaves: one aggregation, without state."""
    return last_changes(log, keys, seq).where(F.col(op) != "delete").drop(op, seq)


def log_to_weights(log: DataFrame, keys: Keys, op: str, seq: str) -> ZFrame:
    """A change log as weighted rows: each change's row with +1 (deletes none), and what the
    key held before it with -1."""
    k = key_list(keys)
    columns = [c for c in log.columns if c not in (op, seq)]
    over = Window.partitionBy(*k).orderBy(seq)
    row = F.when(F.col(op) != "delete", F.struct(*columns))
    steps = log.select(row.alias("_new"), F.lag(row).over(over).alias("_old"))
    plus = steps.where("_new IS NOT NULL").select("_new.*", F.lit(1).cast("long").alias(W))
    minus = steps.where("_old IS NOT NULL").select("_old.*", F.lit(-1).cast("long").alias(W))
    return ZFrame(plus.unionByName(minus))


def residue_steps(rows: DataFrame, key: str) -> list[ZFrame]:
    """Three deltas of a table by its key's last digit: 0-6; then 7, 8 and not 3; then 9, 3
    again and not 5. In the end all rows but those of residue 5 are there."""
    digit = F.pmod(F.col(key), F.lit(10))

    def step(plus: list[int], minus: list[int]) -> ZFrame:
        return ZFrame.of(rows.where(digit.isin(plus + minus)), F.when(digit.isin(minus), -1).otherwise(1))

    return [step([0, 1, 2, 3, 4, 5, 6], []), step([7, 8], [3]), step([9, 3], [5])]


def change_batch(rows: DataFrame, key: str, share: float, change: dict[str, Column], seed: int = 0) -> ZFrame:
    """A delta of about ``share`` of the rows by a hash of their key: two fifths inserted (under
    a negated key), two fifths updated by ``change``, one fifth deleted."""
    slot = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000))
    kind = F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(5))
    picked = rows.where(slot < int(share * 1_000_000)).withColumn("_kind", kind)
    inserts = picked.where("_kind < 2").withColumn(key, -F.col(key) - 1).drop("_kind")
    updated = picked.where("_kind >= 2 AND _kind < 4").drop("_kind")
    deleted = picked.where("_kind = 4").drop("_kind")
    return ZFrame.of(inserts).add(ZFrame.of(updated.withColumns(change))).add(ZFrame.of(updated.unionByName(deleted), -1))
