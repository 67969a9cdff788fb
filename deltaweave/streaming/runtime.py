"""Structured Streaming drivers: views kept up to date by micro-batches, lateness and ordering.

Sources are Spark's (files with ``maxFilesPerTrigger``, Kafka, rate); back-pressure is theirs.
State that must survive is the query's checkpoint plus a folder of generations, one a batch: a
batch is applied as a whole or not at all, once, and a restarted driver goes on from the last one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from threading import Condition, Event, Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deltaweave.operators.zframe import ZFrame
from deltaweave.plans.circuit import Circuit, Collected, View
from deltaweave.plans.incremental import Stateful
from deltaweave.plans.state import Segments
from deltaweave.session import cut, measured_cut


def keep_newest(batch: DataFrame, seq: str, capacity: int) -> DataFrame:
    """Drop-oldest overflow: the ``capacity`` newest messages of a batch."""
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    return batch.orderBy(F.desc(seq)).limit(capacity)


def keep_oldest(batch: DataFrame, seq: str, capacity: int) -> DataFrame:
    """Drop-newest overflow: the ``capacity`` oldest messages of a batch."""
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    return batch.orderBy(F.asc(seq)).limit(capacity)


def keep_all(batch: DataFrame, seq: str, capacity: int) -> DataFrame:
    """Blocking overflow: nothing is dropped. The source holds back what goes beyond, by
    ``files_a_batch`` of its reader; a batch beyond the capacity all the same is an error."""
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    if batch.limit(capacity + 1).count() > capacity:
        raise BufferError(f"a batch holds more than {capacity} messages; bound the source's batches")
    return batch


#: What to do with a batch that exceeds its capacity, by name.
OVERFLOW = {"drop-oldest": keep_newest, "drop-newest": keep_oldest, "block": keep_all}


def drop_stale(batch: DataFrame, ts: str, max_age: str, now: Column | None = None) -> DataFrame:
    """Messages no older than ``max_age`` (an SQL interval)."""
    return batch.where(F.col(ts) >= (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {max_age}"))


def first_by_id(batch: DataFrame, message_id: str, seq: str) -> DataFrame:
    """The first message of each id; messages without one all stay, where they are."""
    known = batch.where(F.col(message_id).isNotNull())
    first = known.groupBy(message_id).agg(F.min_by(F.struct("*"), seq).alias("_row")).select("_row.*")
    return first.unionByName(batch.where(F.col(message_id).isNull()))


def freshness(batch: DataFrame, ts: str, now: Column | None = None) -> DataFrame:
    """Messages and the age in seconds of the oldest one."""
    at = F.current_timestamp() if now is None else now
    return batch.agg(F.count("*").alias("messages"), F.max(at.cast("double") - F.col(ts).cast("double")).alias("lag_seconds"))


def in_batches(source: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, every: str = "1 second") -> StreamingQuery:
    """``process(batch, batch_id)`` for each micro-batch, one at a time; a failed batch is run
    again from the checkpoint, so ``process`` must be idempotent by batch id."""
    writer = source.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


class Seen(Stateful):
    """Message ids met so far: the first message of each id passes, in this batch or any before."""

    def __init__(self, message_id: str, seq: str) -> None:
        self.message_id, self.seq = message_id, seq
        self.segments = Segments(lambda df: df.distinct(), [message_id])

    def parts(self) -> list:
        return [self.segments]

    def reset(self) -> None:
        self.segments.levels = [[]]

    def __call__(self, batch: DataFrame) -> DataFrame:
        """The batch without messages whose id has been met; those without an id all pass."""
        first = first_by_id(batch, self.message_id, self.seq)
        ids, size = measured_cut(first.where(F.col(self.message_id).isNotNull()).select(self.message_id).distinct())
        known = self.segments.touching(ids, size)
        if known is not None:
            known = known.select(F.col(self.message_id).alias("_known"))
            first = first.join(known, first[self.message_id] == known["_known"], "left_anti")
        first = cut(first)
        self.segments.append(first.where(F.col(self.message_id).isNotNull()).select(self.message_id))
        return first


class MaintainedViews:
    """A circuit fed by streaming tables; many views share each batch's delta.

    After each batch every view's delta is written under ``target/view_delta/batch=step`` and,
    each ``whole_every`` steps, its current rows under ``target/view/batch=step``. Then a manifest
    under ``target/_state`` says where the state of all nodes is and which batch of each table
    was applied last; with it the batch is done. A batch that fails before leaves the state as it
    was and may be run again; a batch id that has been applied is not applied again. Built anew
    over a target with a manifest, the views go on from there. Tables may be fed by queries of
    their own: their batches take turns. Without a target the state lives as long as the driver.
    """

    def __init__(self, circuit: Circuit, table: str, to_delta: Callable[[DataFrame], ZFrame] | None = None, target: str | None = None, whole_every: int = 1) -> None:
        self.circuit, self.target, self.whole_every = circuit, target, whole_every
        self.views: dict[str, Collected] = {}
        self.filters: list[Stateful] = []
        self.applied: dict[str, int] = {}
        self.turn, self.going, self.begun = Lock(), Event(), False
        self.going.set()
        self.done = Condition()
        self.failed: dict[str, list[int]] = {}
        self.process = self.feed(table, to_delta)

    def feed(self, table: str, to_delta: Callable[[DataFrame], ZFrame] | None = None, seen: Seen | None = None, drop_failed: bool = False) -> Callable[[DataFrame, int], None]:
        """The function of (batch, batch_id) that takes this table's batches.

        With ``seen`` messages whose id has been met in any batch are left out. With
        ``drop_failed`` a batch that fails is noted in ``failed`` and passed over instead of
        being run again.
        """
        if seen is not None:
            self.filters.append(seen)

        def process(batch: DataFrame, batch_id: int) -> None:
            self.going.wait()
            with self.turn:
                self._begin()
                if batch_id <= self.applied.get(table, -1):
                    return
                before = self._save()
                try:
                    rows = batch if seen is None else seen(batch)
                    self.circuit.step({table: (to_delta or ZFrame.of)(rows)})
                    self.applied[table] = batch_id
                    self._commit()
                except Exception:
                    self._restore(before)
                    if not drop_failed:
                        raise
                    self.failed.setdefault(table, []).append(batch_id)
                    self.applied[table] = batch_id
                    self._commit()
            with self.done:
                self.done.notify_all()

        return process

    # -- control -----------------------------------------------------------------------

    def pause(self) -> None:
        """Hold batches back from now on; the one that runs is finished."""
        self.going.clear()

    def resume(self) -> None:
        self.going.set()

    def flush(self, table: str, batch_id: int, seconds: float = 60.0) -> bool:
        """Wait until a batch of a table has been applied; whether it has been."""
        with self.done:
            return self.done.wait_for(lambda: self.applied.get(table, -1) >= batch_id, seconds)

    # -- state -------------------------------------------------------------------------

    def _parts(self) -> list[Stateful]:
        return [self.circuit, *self.views.values(), *self.filters]

    def _begin(self) -> None:
        """Before the first batch: keep state under the target, and take up what is there."""
        if self.begun:
            return
        self.begun = True
        if self.target is None:
            return
        for part in self._parts():
            part.keep_under(f"{self.target}/_state/segments")
        if (text := last_manifest(self.circuit.spark, f"{self.target}/_state/manifests")) is not None:
            self._restore(json.loads(text))

    def _save(self) -> dict:
        return {"parts": [p.save() for p in self._parts()], "applied": dict(self.applied), "views": list(self.views), "failed": self.failed}

    def _restore(self, saved: dict) -> None:
        if saved["views"] != list(self.views):
            raise ValueError("the saved state is of other views")
        for part, own in zip(self._parts(), saved["parts"], strict=True):
            part.restore(self.circuit.spark, own)
        self.applied, self.failed = dict(saved["applied"]), saved["failed"]

    def _commit(self) -> None:
        if self.target is not None:
            write_manifest(self.circuit.spark, f"{self.target}/_state/manifests", json.dumps(self._save()))

    def view(self, name: str, handle: View) -> None:
        self.views[name] = sink = Collected()

        def deliver(delta: ZFrame) -> None:
            sink(delta)
            if self.target:
                delta.entries().write.mode("overwrite").parquet(f"{self.target}/{name}_delta/batch={self.circuit.steps}")
                if self.circuit.steps % self.whole_every == 0:
                    sink.table.entries().write.mode("overwrite").parquet(f"{self.target}/{name}/batch={self.circuit.steps}")

        handle.output(deliver)

    def current(self, name: str) -> ZFrame | None:
        with self.turn:
            self._begin()
        return self.views[name].table


def write_manifest(spark: SparkSession, folder: str, text: str, keep: int = 3) -> None:
    """A new generation of a small text: written aside and renamed, so it is there whole or not
    at all. Of older ones ``keep`` stay."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    taken = _manifests(spark, folder)
    number = taken[-1] + 1 if taken else 0
    aside = path(f"{folder}/.{number:012d}")
    out = files.create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if not files.rename(aside, path(f"{folder}/{number:012d}.json")):
        raise OSError(f"cannot put a manifest into {folder}")
    for old in taken[: max(0, len(taken) + 1 - keep)]:
        files.delete(path(f"{folder}/{old:012d}.json"), False)


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def last_manifest(spark: SparkSession, folder: str) -> str | None:
    """The newest generation's text."""
    taken = _manifests(spark, folder)
    return spark.read.text(f"{folder}/{taken[-1]:012d}.json", wholetext=True).first()[0] if taken else None


def as_timestamps(df: DataFrame) -> DataFrame:
    """Zone-less timestamps as timestamps of the session's zone: watermarks need them."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"})


def interval_join(left: DataFrame, right: DataFrame, key: tuple[str, str], times: tuple[str, str], within: str, lateness: str, how: str = "inner") -> DataFrame:
    """Stream-stream join of rows at most ``within`` apart; Spark evicts state by watermark."""
    a, b = left.withWatermark(times[0], lateness), right.withWatermark(times[1], lateness)
    span = F.expr(f"INTERVAL {within}")
    return a.join(b, (a[key[0]] == b[key[1]]) & (b[times[1]] >= a[times[0]] - span) & (b[times[1]] <= a[times[0]] + span), how)
