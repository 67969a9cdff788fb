"""Incremental operators: each takes this step's deltas and returns its output's delta.

State lives in the shared folder (``state``): a step adds its change, and segments are merged by
levels, so neither plans nor rewriting grow with the number of steps. Linear operators need none.
Joins probe the state with delta rows; grouped operators touch only the delta's keys. Deltas are
cut and measured once; small ones are broadcast to the state, so a step does not shuffle it.
What a step returns is lazy over cut frames.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.operators import joins
from deltaweave.operators.joins import Keys, key_list
from deltaweave.operators.zframe import Condition, W, ZFrame, as_column, weighed
from deltaweave.plans.state import SMALL, Cell, Segments
from deltaweave.session import known_empty, known_size, measured_cut, observed_cut


class Stateful:
    """An operator whose state can be saved, restored and kept under a folder.

    ``parts`` are its logs, cells and inner operators; ``marks`` names its plain attributes.
    """

    marks: tuple[str, ...] = ()

    def parts(self) -> list:
        return []

    def keep_under(self, folder: str) -> None:
        """From now on write state as tables that outlive the driver."""
        for part in self.parts():
            if isinstance(part, Stateful):
                part.keep_under(folder)
            else:
                part.folder = folder

    def save(self) -> dict:
        return {"parts": [p.save() for p in self.parts()], "marks": {m: getattr(self, m) for m in self.marks}}

    def restore(self, spark: SparkSession, saved: dict) -> None:
        for part, own in zip(self.parts(), saved["parts"], strict=True):
            part.restore(spark, own)
        for name, value in saved["marks"].items():
            setattr(self, name, value)


def measured(delta: ZFrame) -> tuple[ZFrame, int]:
    """The delta, cut, and its bytes: as it is if it has been cut before, else consolidated."""
    if (size := known_size(delta.df)) is not None:
        return delta, size
    frame, size = measured_cut(delta.consolidate().df)
    return ZFrame(frame), size


def small(delta: ZFrame, size: int) -> ZFrame:
    """The delta marked for broadcasting if its measured bytes allow it."""
    return ZFrame(F.broadcast(delta.df)) if 0 < size <= SMALL else delta


class Integral(Stateful):
    """The sum of all deltas so far (operator I). ``state`` is it unconsolidated; ``keys`` are
    what readers look rows up by."""

    def __init__(self, keys: Keys = ()) -> None:
        self.segments = Segments(lambda df: ZFrame(df).consolidate().df, key_list(keys))

    def parts(self) -> list:
        return [self.segments]

    def reset(self) -> None:
        self.segments.levels = [[]]

    @property
    def state(self) -> ZFrame | None:
        held = self.segments.all()
        return None if held is None else ZFrame(held)

    def step(self, delta: ZFrame) -> ZFrame:
        self.segments.append(delta.consolidate().df)
        return (self.state or delta.empty()).consolidate()

    def add(self, delta: ZFrame, size: int) -> None:
        """Take a delta that ``measured`` has cut."""
        self.segments.append(delta.df, size)

    def before(self, delta: ZFrame) -> ZFrame:
        """The sum before this step (to be called before ``step``)."""
        return self.state or delta.empty()

    def touching(self, delta: ZFrame, known: DataFrame, size: int) -> ZFrame:
        """Rows of the sum with the known keys."""
        rows = self.segments.touching(known, size)
        return delta.empty() if rows is None else ZFrame(rows)


class Differential(Stateful):
    """This step's table minus the last one's (operator D). The table is replaced each step, as
    whole tables are what it is given."""

    def __init__(self) -> None:
        self.last = Cell()

    def parts(self) -> list:
        return [self.last]

    def reset(self) -> None:
        self.last.clear()

    def step(self, table: ZFrame) -> ZFrame:
        before = self.last.frame
        now = ZFrame(self.last.put(table.consolidate().df))
        return now if before is None else now.subtract(ZFrame(before)).consolidate()


class Delay(Stateful):
    """The last step's delta (operator z^-1), the empty table at first."""

    def __init__(self) -> None:
        self.held = Cell()

    def parts(self) -> list:
        return [self.held]

    def reset(self) -> None:
        self.held.clear()

    def step(self, delta: ZFrame) -> ZFrame:
        before = self.held.frame
        self.held.put(delta.df)
        return delta.empty() if before is None else ZFrame(before)


class Linear(Stateful):
    """Filters, projections, flat maps and unions: the delta goes straight through."""

    def __init__(self, operator: Callable[..., ZFrame]) -> None:
        self.operator = operator

    def step(self, *deltas: ZFrame) -> ZFrame:
        return self.operator(*deltas)

    def reset(self) -> None:
        pass


class Incrementalized(Stateful):
    """``D(Q(I(.)))`` of any query: exact, and a full recomputation a step."""

    def __init__(self, query: Callable[..., ZFrame], inputs: int = 1) -> None:
        self.query, self.integrals, self.difference = query, [Integral() for _ in range(inputs)], Differential()

    def parts(self) -> list:
        return [*self.integrals, self.difference]

    def step(self, *deltas: ZFrame) -> ZFrame:
        return self.difference.step(self.query(*(i.step(d) for i, d in zip(self.integrals, deltas, strict=True))))

    def reset(self) -> None:
        for part in (*self.integrals, self.difference):
            part.reset()


class Join(Stateful):
    """Bilinear inner join: new x new, old x new and new x old."""

    def __init__(self, left_keys: Keys, right_keys: Keys, where: Condition | None = None, select: Sequence[Condition] | None = None) -> None:
        self.arguments = (left_keys, right_keys, where, select)
        self.left, self.right = Integral(left_keys), Integral(right_keys)

    def parts(self) -> list:
        return [self.left, self.right]

    def _join(self, a: ZFrame, b: ZFrame) -> ZFrame:
        return joins.join(a, b, *self.arguments)

    def _probe(self, integral: Integral, own: ZFrame, keys: Keys, other: ZFrame, other_keys: Keys, size: int) -> ZFrame:
        """The state's rows that can meet the other side's delta."""
        if size > SMALL:
            return integral.before(own)
        known = other.df.select(*(F.col(f"`{k}`") for k in key_list(other_keys))).dropna().distinct()
        return integral.touching(own, known, size) if any(s.buckets for s in integral.segments.held()) else integral.before(own)

    def step(self, left: ZFrame, right: ZFrame) -> ZFrame:
        return self._meet(*measured(left), *measured(right)).consolidate()

    def _meet(self, left: ZFrame, left_size: int, right: ZFrame, right_size: int) -> ZFrame:
        left_keys, right_keys = self.arguments[:2]
        old_left = self._probe(self.left, left, left_keys, right, right_keys, right_size)
        old_right = self._probe(self.right, right, right_keys, left, left_keys, left_size)
        a, b = small(left, left_size), small(right, right_size)
        out = self._join(left, b).add(self._join(old_left, b)).add(self._join(a, old_right))
        self.left.add(left, left_size)
        self.right.add(right, right_size)
        return out

    def reset(self) -> None:
        self.left.reset()
        self.right.reset()


class AppendOnlyJoin(Join):
    """The same for sides that only grow; a retraction is an error, not a wrong answer. The signs
    are checked in the job that cuts the delta. As nothing is ever taken back, neither deltas nor
    results are consolidated: a step does not shuffle but for joins of large deltas."""

    def step(self, left: ZFrame, right: ZFrame) -> ZFrame:
        given = []
        for name, side in (("left", left), ("right", right)):
            frame, size, seen = observed_cut(side.df, least=F.min(W))
            if seen["least"] is not None and seen["least"] < 0:
                raise ValueError(f"the {name} side of an append-only join got a retraction")
            given += [ZFrame(frame), size]
        return self._meet(*given)


class Distinct(Stateful):
    """A row appears when its weight turns positive and disappears when it ceases to be.

    Only the rows of the delta are looked up in the state."""

    def __init__(self) -> None:
        self.integral = Integral()

    def parts(self) -> list:
        return [self.integral]

    def step(self, delta: ZFrame) -> ZFrame:
        delta, size = measured(delta)
        self.integral.segments.keys = delta.columns
        old = self.integral.touching(delta, delta.df.select(*delta.cols()), size)
        tagged = delta.df.withColumn("_old", F.lit(0).cast("long")).unionByName(old.df.withColumn("_old", F.col(W)).withColumn(W, F.lit(0).cast("long")))
        both = tagged.groupBy(*delta.cols()).agg(F.sum(W).alias("_new"), F.sum("_old").alias("_old"))
        sign = (F.col("_old") + F.col("_new") > 0).cast("long") - (F.col("_old") > 0).cast("long")
        self.integral.add(delta, size)
        return ZFrame(both.select(*delta.cols(), sign.alias(W)).where(F.col(W) != 0))

    def reset(self) -> None:
        self.integral.reset()


class ByKey(Stateful):
    """Any query that works key by key (outer, semi and anti joins, min and max, top-k a group):
    only the delta's keys are recomputed, before and after.

    ``keys`` gives each input's key columns, in the same order and of the same types.
    """

    def __init__(self, query: Callable[..., ZFrame], *keys: Keys) -> None:
        self.query, self.keys = query, [key_list(k) for k in keys]
        self.integrals = [Integral(k) for k in self.keys]

    def parts(self) -> list:
        return list(self.integrals)

    def step(self, *deltas: ZFrame) -> ZFrame:
        cuts = [measured(d) for d in deltas]
        if all(known_empty(d.df) for d, _ in cuts):
            return self.query(*(d for d, _ in cuts))
        names = [f"_k{i}" for i in range(len(self.keys[0]))]
        own = [d.df.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True))) for (d, _), keys in zip(cuts, self.keys, strict=True)]
        touched, size = measured_cut(reduce(DataFrame.union, own).distinct())
        # both sides of the difference read these, so they are computed once
        olds = [ZFrame(measured_cut(i.touching(d, touched, size).consolidate().df)[0]) for i, (d, _) in zip(self.integrals, cuts, strict=True)]
        news = [old.add(d).consolidate() for old, (d, _) in zip(olds, cuts, strict=True)]
        for integral, (d, n) in zip(self.integrals, cuts, strict=True):
            integral.add(d, n)
        return self.query(*news).subtract(self.query(*olds)).consolidate()

    def reset(self) -> None:
        for i in self.integrals:
            i.reset()


def semi_join(left_keys: Keys, right_keys: Keys) -> ByKey:
    return ByKey(lambda a, b: joins.semi_join(a, b, left_keys, right_keys), left_keys, right_keys)


def anti_join(left_keys: Keys, right_keys: Keys) -> ByKey:
    return ByKey(lambda a, b: joins.anti_join(a, b, left_keys, right_keys), left_keys, right_keys)


def outer_join(left_keys: Keys, right_keys: Keys, how: str) -> ByKey:
    return ByKey(lambda a, b: joins.outer_join(a, b, left_keys, right_keys, how), left_keys, right_keys)


def extremes(keys: Keys, **measures: tuple[str, Condition]) -> ByKey:
    """``name=("min" | "max", expression)`` by key, with exact retraction."""

    def query(rows: ZFrame) -> ZFrame:
        functions = {"min": F.min, "max": F.max}
        positive = rows.consolidate().df.where(F.col(W) > 0)
        return ZFrame.of(positive.groupBy(*key_list(keys)).agg(*(functions[f](as_column(e)).alias(n) for n, (f, e) in measures.items())))

    return ByKey(query, keys)


def top_k(keys: Keys, order: Sequence[Column], k: int) -> ByKey:
    """The first ``k`` rows of each key in a total order (of rows of positive weight)."""
    from pyspark.sql import Window

    def query(rows: ZFrame) -> ZFrame:
        ranked = rows.bag().withColumn("_rank", F.row_number().over(Window.partitionBy(*key_list(keys)).orderBy(*order)))
        return ZFrame.of(ranked.where(F.col("_rank") <= k).drop("_rank"))

    return ByKey(query, keys)


class GroupSums(Stateful):
    """COUNT, SUM and AVG by key from mergeable partials.

    The state holds each key's partials as of its last change, with the step's number: total
    weight, and for each measure the sum and the weight of its non-null values, so SUM is null
    exactly when no non-null value is left. A step looks up the keys of its delta, adds, and
    appends the new partials; each key whose row changed gives the old row, as it was given, with
    weight -1 and the new one with +1. Floating-point sums may carry rounding, as running sums do,
    but what is taken back is always what was given. Without keys there is one group, and with
    ``always`` it has a row even when it is empty, as an SQL aggregate without GROUP BY has.
    """

    marks = ("clock",)

    def __init__(self, keys: Keys, /, always: bool = False, **measures: tuple[str, Condition | None]) -> None:
        self.keys, self.measures, self.always = key_list(keys), measures, always and not key_list(keys)
        if unknown := {kind for kind, _ in measures.values()} - {"count", "sum", "avg"}:
            raise ValueError(f"{unknown} are not mergeable; use extremes()")
        self.segments = Segments(self._latest, self.keys)
        self.clock = 0

    def parts(self) -> list:
        return [self.segments]

    def reset(self) -> None:
        self.segments.levels, self.clock = [[]], 0

    def _by_key(self) -> list[Column]:
        return [F.col(f"`{k}`") for k in self.keys]

    def _latest(self, partials: DataFrame) -> DataFrame:
        """The newest partials of each key. Emptied keys stay, as older segments may hold them."""
        names = [c for c in partials.columns if c not in self.keys]
        return partials.groupBy(*self._by_key()).agg(F.max_by(F.struct(*names), "_seq").alias("_x")).select(*self._by_key(), "_x.*")

    def _partials(self, delta: ZFrame) -> DataFrame:
        parts = [F.coalesce(F.sum(W), F.lit(0)).alias("_n")]
        for name, (function, expression) in self.measures.items():
            if expression is None:
                continue
            e = as_column(expression)
            parts.append(F.coalesce(F.sum(F.when(e.isNotNull(), F.col(W))), F.lit(0)).alias(f"_c_{name}"))
            if function != "count":
                kind, total = delta.df.select(e.alias("e")).schema["e"].dataType, F.sum(weighed(delta.df, e))
                if kind.typeName() == "decimal":  # one digit is left for the addition of two partials
                    total = total.cast(f"decimal(37,{kind.scale})")
                parts.append(total.alias(f"_s_{name}"))
        return delta.df.groupBy(*self._by_key()).agg(*parts)

    def _row(self, side: str) -> Column:
        """The group's row as a struct of the measures of one side's partials; null if there is none."""
        out = []
        for name, (kind, expression) in self.measures.items():
            s, c = F.col(f"{side}._s_{name}"), F.col(f"{side}._c_{name}")
            if kind == "count":
                value = F.col(f"{side}._n") if expression is None else c
            elif kind == "sum":
                value = F.when(c != 0, s)
            else:
                value = F.when(c != 0, s.cast("double") / c)
            out.append(value.alias(name))
        here = F.col(f"{side}._n").isNotNull() if self.always else F.col(f"{side}._n") != 0
        return F.when(here, F.struct(*out))

    def step(self, delta: ZFrame) -> ZFrame:
        change, size = self._partials(delta), known_size(delta.df)
        if size is None or size > SMALL:  # partials are no larger than a small delta
            change, size = measured_cut(change)
        names = [c for c in change.columns if c not in self.keys]
        kinds = {m: change.schema[m].dataType for m in names}
        rows = change.select(*self._by_key(), *names, F.lit(None).cast("long").alias("_seq"), F.lit(None).cast(change.select(F.struct(*names).alias("_o")).schema["_o"].dataType).alias("_o"))
        held = None if known_empty(change) else self.segments.touching(change.select(*self._by_key()), size)
        if held is not None:
            rows = rows.unionByName(held.select(*self._by_key(), *(F.lit(None).cast(kinds[m]).alias(m) for m in names), "_seq", F.struct(*names).alias("_o")))
        both = rows.groupBy(*self._by_key()).agg(F.max_by("_o", "_seq").alias("_o"), *(F.sum(m).cast(kinds[m]).alias(m) for m in names))

        def added(m: str) -> Column:
            total = F.coalesce(F.col(f"_o.{m}") + F.col(m), F.col(f"_o.{m}"), F.col(m)).cast(kinds[m])
            if m.startswith("_s_"):  # rounding does not outlive the values
                weight = f"_c_{m[3:]}"
                total = F.when(F.coalesce(F.col(f"_o.{weight}"), F.lit(0)) + F.col(weight) != 0, total)
            return total.alias(m)

        both, size = measured_cut(both.select(*self._by_key(), "_o", F.struct(*(added(m) for m in names)).alias("_new")))
        self.clock += 1
        self.segments.append(both.select(*self._by_key(), F.lit(self.clock).cast("long").alias("_seq"), "_new.*"), size)
        changed = both.select(*self._by_key(), self._row("_o").alias("_was"), self._row("_new").alias("_is")).where(~F.col("_was").eqNullSafe(F.col("_is")))
        signed = F.array(F.struct(F.col("_is").alias("r"), F.lit(1).cast("long").alias(W)), F.struct(F.col("_was").alias("r"), F.lit(-1).cast("long").alias(W)))
        return ZFrame(changed.select(*self._by_key(), F.explode(signed).alias("_x")).where("_x.r IS NOT NULL").select(*self._by_key(), "_x.r.*", f"_x.{W}"))


class PrunedJoin(Stateful):
    """Equi-join whose sides forget rows older than the other side's watermark by more than
    ``retention`` (same unit as the time columns); their results go too. Rows of one step count
    as arriving together, in time order.

    A step joins the deltas with what is held, and what falls behind a watermark with the other
    side, so it touches the rows that come and go, not all results.
    """

    marks = ("seen", "pruned")

    def __init__(self, left_keys: Keys, right_keys: Keys, left_ts: str, right_ts: str, retention: float) -> None:
        self.keys, self.times, self.retention = (left_keys, right_keys), (left_ts, right_ts), retention
        self.inner = Join(left_keys, right_keys)
        self.reset()

    def parts(self) -> list:
        return [self.inner]

    def reset(self) -> None:
        self.inner.reset()
        self.seen: list[float | None] = [None, None]
        self.pruned = [0, 0]

    def step(self, left: ZFrame, right: ZFrame) -> ZFrame:
        deltas = [measured(left)[0], measured(right)[0]]
        marks = list(self.seen)
        for k in (0, 1):
            latest = deltas[k].df.agg(F.max(self.times[k])).first()[0]
            if latest is not None:
                marks[k] = latest if marks[k] is None else max(latest, marks[k])
        out = list(deltas)
        if self.retention > 0:
            for k in (0, 1):
                if (mark := marks[1 - k]) is not None:
                    late = F.col(self.times[k]) < mark - self.retention
                    held = (self.inner.left, self.inner.right)[k].before(deltas[k]).filter(late)
                    gone = ZFrame(measured_cut(held.add(deltas[k].filter(late)).consolidate().df)[0])
                    self.pruned[k] += gone.size()
                    out[k] = deltas[k].subtract(gone)
        self.seen = marks
        return self.inner.step(*out)

    def memory(self) -> dict[str, int]:
        """Rows held by side, bytes of the state's segments, and rows forgotten by side."""
        sides = (self.inner.left, self.inner.right)
        held = [0 if s.state is None else s.state.size() for s in sides]
        return {"left_rows": held[0], "right_rows": held[1], "state_bytes": sum(x.size for s in sides for x in s.segments.held()), "left_pruned": self.pruned[0], "right_pruned": self.pruned[1]}
