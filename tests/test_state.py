"""Stateful operators over many steps, state by bucket, and views that survive failures and restarts."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from deltaweave import examples
from deltaweave.operators import joins
from deltaweave.operators.zframe import ZFrame
from deltaweave.plans import builders, state
from deltaweave.plans import incremental as inc
from deltaweave.plans.circuit import Circuit, Collected
from deltaweave.session import observed_cut, use_checkpoints
from deltaweave.sources.feeds import Feed
from deltaweave.streaming.runtime import OVERFLOW, MaintainedViews, Seen, last_manifest

LEFT, RIGHT = "a long, b long", "k long, v long"


def z(spark, entries, schema):
    return ZFrame.from_entries(spark, entries, schema)


def groups(t):
    return ZFrame.of(t.bag().groupBy("a").agg(F.sum("b").alias("s"), F.count("*").alias("n"), F.avg("b").alias("m")))


def first_two(t):
    ranked = t.bag().withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("b")))
    return ZFrame.of(ranked.where("r <= 2").drop("r"))


#: Every stateful operator with its batch, and the number of its inputs.
OPERATORS = {
    "group_sums": (lambda: inc.GroupSums("a", s=("sum", "b"), n=("count", None), m=("avg", "b")), groups, 1),
    "distinct": (inc.Distinct, lambda t: t.distinct(), 1),
    "extremes": (lambda: inc.extremes("a", lo=("min", "b")), lambda t: ZFrame.of(t.bag().groupBy("a").agg(F.min("b").alias("lo"))), 1),
    "top_k": (lambda: inc.top_k("a", [F.asc("b")], 2), first_two, 1),
    "join": (lambda: inc.Join("a", "k"), lambda a, b: joins.join(a, b, "a", "k"), 2),
    "semi": (lambda: inc.semi_join("a", "k"), lambda a, b: joins.semi_join(a, b, "a", "k"), 2),
    "anti": (lambda: inc.anti_join("a", "k"), lambda a, b: joins.anti_join(a, b, "a", "k"), 2),
    "full": (lambda: inc.outer_join("a", "k", "full"), lambda a, b: joins.outer_join(a, b, "a", "k", "full"), 2),
    "generic": (lambda: inc.Incrementalized(lambda t: t.filter("b > 0")), lambda t: t.filter("b > 0"), 1),
}


def set_fan(operator, fan):
    for part in operator.parts():
        if isinstance(part, state.Segments):
            part.fan = fan
        elif isinstance(part, inc.Stateful):
            set_fan(part, fan)


def changes(rng, held, size):
    """Some rows go, some come; one key is updated in every step."""
    change = {}
    for row in rng.sample(sorted(held, key=repr), len(held) // 4):
        change[row] = change.get(row, 0) - 1
        held.remove(row)
    for _ in range(size):
        row = (rng.choice([None, 1, 2, 3, 4]), rng.randint(0, 3))
        change[row] = change.get(row, 0) + 1
        held.append(row)
    for row in [r for r in held if r[0] == 77]:
        change[row] = change.get(row, 0) - 1
        held.remove(row)
    row = (77, rng.randint(0, 9))
    change[row] = change.get(row, 0) + 1
    held.append(row)
    return list(change.items())


def run(spark, name, steps, fan, seed=0):
    make, batch, inputs = OPERATORS[name]
    rng, operator, sink = random.Random(f"{name}{seed}"), make(), Collected()
    set_fan(operator, fan)
    held, schemas = [[] for _ in range(inputs)], (LEFT, RIGHT)[:inputs]
    for _ in range(steps):
        sink(operator.step(*(z(spark, changes(rng, h, 2), s) for h, s in zip(held, schemas, strict=True))))
    want = batch(*(z(spark, [(r, 1) for r in h], s) for h, s in zip(held, schemas, strict=True)))
    assert sink.table.equals(want), name


@pytest.mark.parametrize(("fan", "steps"), [(1, 100), (2, 25), (8, 25)])
def test_group_sums_over_many_steps(spark, fan, steps):
    run(spark, "group_sums", steps, fan)


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "group_sums"])
def test_operators_over_many_steps(spark, name):
    run(spark, name, 8, {"join": 1, "distinct": 2}.get(name, 3))


def test_state_by_bucket_gives_the_same(spark, monkeypatch):
    """Every segment a Parquet table by bucket."""
    monkeypatch.setattr(state, "LARGE", -1)
    for name in ("group_sums", "join", "distinct", "extremes"):
        run(spark, name, 5, 2, seed=1)


def test_only_the_buckets_of_the_keys_are_read(spark, monkeypatch):
    monkeypatch.setattr(state, "LARGE", -1)
    log = state.Segments(lambda df: df, ["k"])
    log.append(spark.range(1000).selectExpr("id AS k", "id * 2 AS v"))
    known = spark.createDataFrame([(5,)], "k long")
    found = log.touching(known, 8)
    assert [tuple(r) for r in found.collect()] == [(5, 10)]
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*__b", plan) and "Broadcast" in plan


def test_rounding_is_taken_back_as_it_was_given(spark):
    """Floating-point sums: the row that goes is the row that came."""
    rng, op, sink = random.Random(3), inc.GroupSums("g", s=("sum", "x")), Collected()
    set_fan(op, 1)
    for _ in range(12):
        sink(op.step(ZFrame.from_values(spark, [(1, rng.random()) for _ in range(3)], "g long, x double")))
    assert sink.table.size() == 1 and sink.table.is_set()


def test_decimals_and_empty_groups(spark):
    op, sink = inc.GroupSums("g", s=("sum", "x"), n=("count", "x")), Collected()
    rows = spark.sql("SELECT 1L AS g, CAST(1.23456789 AS DECIMAL(18,8)) AS x")
    sink(op.step(ZFrame.of(rows)))
    sink(op.step(ZFrame.of(rows, 2)))
    assert str(sink.table.bag().first().s) == "3.70370367"
    sink(op.step(ZFrame.of(rows, -3)))
    assert sink.table.is_zero()


@pytest.mark.parametrize(("kind", "value", "total"), [("18,8", "1.23456789", "3.70370367"), ("28,10", "1.2345678901", "3.7037036703")])
def test_decimals_keep_their_scale(spark, kind, value, total):
    rows = ZFrame.of(spark.sql(f"SELECT 1L AS g, CAST({value} AS DECIMAL({kind})) AS x"), 3)
    op, sink = inc.GroupSums("g", s=("sum", "x")), Collected()
    sink(op.step(rows))
    assert str(sink.table.bag().first().s) == str(rows.sum("x").first()[0]) == total


def test_sizes_of_rows_that_turn_out_to_be_none(spark, tmp_path):
    """The planner leaves the observation out where it finds while running that no row can come."""
    none = spark.range(9).repartition(3).where("id < 0").join(spark.range(9).repartition(3), "id").groupBy("id").count()
    out, size, more = observed_cut(none, most=F.max("count"))
    assert out.isEmpty() and size == 0 and more == {"most": None}
    segment = state.write_segment(none, str(tmp_path), ["id"], 2)
    assert segment.size == 0 and segment.rows().isEmpty()


def test_global_aggregates_have_a_row_for_nothing(spark):
    circuit, n, s = Circuit(spark), Collected(), Collected()
    x = circuit.input("x", "v long")
    x.count().output(n)
    x.sum("v").output(s)
    circuit.step({})
    assert [tuple(r) for r in n.table.bag().collect()] == [(0,)] and [tuple(r) for r in s.table.bag().collect()] == [(None,)]
    circuit.step({"x": z(spark, [((4,), 2), ((None,), 1)], "v long")})
    assert [tuple(r) for r in n.table.bag().collect()] == [(3,)] and [tuple(r) for r in s.table.bag().collect()] == [(8,)]
    circuit.step({"x": z(spark, [((4,), -2)], "v long")})
    assert [tuple(r) for r in n.table.bag().collect()] == [(1,)] and [tuple(r) for r in s.table.bag().collect()] == [(None,)]


def test_asof_with_nulls(spark):
    left = spark.createDataFrame([(None, 5, "a"), (1, None, "b"), (1, 5, "c"), (2, 5, "d")], "k long, t long, n string")
    right = spark.createDataFrame([(None, 1, 9), (1, None, 7), (1, 3, 8), (2, None, 6)], "k long, t long, x long")
    for forward, wanted in ((False, 8), (True, None)):
        got = {r.n: r.x for r in joins.asof_join(left, right, ["k"], "t", "t", ["x"], forward).collect()}
        assert got == {"a": None, "b": None, "c": wanted, "d": None}


# -- streaming views -------------------------------------------------------------------


def build(spark, target, **more):
    circuit = Circuit(spark)
    numbers = circuit.input("n", "id long, g long")
    views = MaintainedViews(circuit, "n", target=target, **more)
    views.view("counts", numbers.group_sums("g", n=("count", None), s=("sum", "id")))
    views.view("kept", numbers.filter("id > 1"))
    views.view("ids", numbers.map("id % 4 AS r").distinct())
    return views


def batch(spark, a, b):
    return spark.range(a, b).selectExpr("id", "id % 2 AS g")


def rows(frame):
    return sorted(tuple(r) for r in frame.bag().collect())


def test_a_restarted_driver_goes_on(spark, tmp_path):
    first = build(spark, str(tmp_path))
    first.process(batch(spark, 0, 3), 0)
    first.process(batch(spark, 3, 4), 1)
    again = build(spark, str(tmp_path))
    assert rows(again.current("counts")) == [(0, 2, 2), (1, 2, 4)] and again.applied == {"n": 1}
    again.process(batch(spark, 3, 4), 1)  # Spark runs the last batch again: nothing changes
    again.process(batch(spark, 4, 6), 2)
    assert rows(again.current("counts")) == [(0, 3, 6), (1, 3, 9)] and again.current("kept").size() == 4
    assert rows(again.current("ids")) == [(0,), (1,), (2,), (3,)]
    assert sorted(p.name for p in (tmp_path / "counts").iterdir()) == ["batch=0", "batch=1", "batch=2"]
    assert rows(ZFrame.of(spark.read.parquet(str(tmp_path / "counts" / "batch=0")).drop("weight"))) == [(0, 2, 2), (1, 1, 1)]
    other = Circuit(spark)
    other.input("n", "id long, g long")
    with pytest.raises(ValueError, match="other"):
        MaintainedViews(other, "n", target=str(tmp_path)).process(batch(spark, 0, 1), 9)


def test_a_failed_batch_leaves_no_trace(spark, tmp_path):
    views = build(spark, str(tmp_path))
    views.process(batch(spark, 0, 4), 0)
    broken = {"on": True}

    def fail(delta):
        if broken["on"]:
            raise OSError("no space")

    views.circuit.sinks.append((views.circuit.sinks[0][0], fail))
    with pytest.raises(OSError):
        views.process(batch(spark, 4, 8), 1)
    assert views.applied == {"n": 0} and views.circuit.steps == 1
    broken["on"] = False
    views.process(batch(spark, 4, 8), 1)
    assert rows(views.current("counts")) == [(0, 4, 12), (1, 4, 16)]
    broken["on"] = True
    skip = views.feed("n", drop_failed=True)
    skip(batch(spark, 8, 9), 2)
    assert views.failed == {"n": [2]} and rows(views.current("counts")) == [(0, 4, 12), (1, 4, 16)]
    assert '"failed": {"n": [2]}' in last_manifest(spark, f"{tmp_path}/_state/manifests")


def test_pause_resume_and_flush(spark, tmp_path):
    from threading import Thread

    views = build(spark, None, whole_every=2)
    views.pause()
    worker = Thread(target=views.process, args=(batch(spark, 0, 2), 0))
    worker.start()
    assert not views.flush("n", 0, seconds=0.3)
    views.resume()
    assert views.flush("n", 0, seconds=60)
    worker.join()
    assert rows(views.current("kept")) == []


def test_ids_met_in_earlier_batches_do_not_pass(spark, tmp_path):
    def make():
        circuit = Circuit(spark)
        m = circuit.input("m", "id string, seq long")
        views = MaintainedViews(circuit, "m", target=str(tmp_path))
        views.view("all", m.filter("true"))
        return views, views.feed("m", seen=Seen("id", "seq"))

    data = lambda *r: spark.createDataFrame(r, "id string, seq long")
    views, process = make()
    process(data(("a", 1), ("a", 2), (None, 3)), 0)
    process(data(("a", 4), ("b", 5), (None, 6)), 1)
    views, process = make()  # ids are remembered over a restart
    process(data(("b", 7), ("c", 8)), 2)
    assert sorted(rows(views.current("all")), key=repr) == [("a", 1), ("b", 5), ("c", 8), (None, 3), (None, 6)]


def test_ids_of_earlier_batches_with_nulls(spark, tmp_path):
    """As test_ids_met_in_earlier_batches_do_not_pass, without ordering nulls and strings."""
    circuit = Circuit(spark)
    views = MaintainedViews(circuit, "m", target=str(tmp_path))
    views.view("all", circuit.input("m", "id string, seq long").filter("true"))
    process = views.feed("m", seen=Seen("id", "seq"))
    for k, batch_ in enumerate(([("a", 1), ("a", 2), (None, 3)], [("a", 4), ("b", 5), (None, 6)], [("b", 7), ("c", 8)])):
        process(spark.createDataFrame(batch_, "id string, seq long"), k)
    assert {tuple(r) for r in views.current("all").bag().collect()} == {("a", 1), ("b", 5), ("c", 8), (None, 3), (None, 6)}


def test_overflow_policies(spark):
    messages = spark.range(5).withColumnRenamed("id", "seq")
    assert {p: sorted(r.seq for r in OVERFLOW[p](messages, "seq", 3).collect()) for p in ("drop-oldest", "drop-newest")} == {"drop-oldest": [2, 3, 4], "drop-newest": [0, 1, 2]}
    assert OVERFLOW["block"](messages, "seq", 5).count() == 5
    with pytest.raises(BufferError):
        OVERFLOW["block"](messages, "seq", 4)


def test_feed_controls(spark):
    feed = Feed(lambda ids: ids, spark, rate=3)
    feed.burst(2)
    sizes = [feed.snapshot(4).count(), feed.tick().count(), feed.tick().count()]
    feed.pause()
    sizes.append(feed.tick().count())
    feed.resume()
    feed.rate = 1
    assert [*sizes, feed.tick().count(), feed.sent] == [4, 5, 3, 0, 1, 13]


# -- canned circuits and examples ------------------------------------------------------


def test_canned_circuits(spark):
    delta = z(spark, [((1, 5), 1), ((2, 50), 2)], LEFT)
    got = lambda built: {tuple(r) for r in built.step(delta).entries().collect()}
    assert got(builders.filter_query(spark, LEFT, "b > 9")) == {(2, 50, 2)}
    assert got(builders.map_query(spark, LEFT, "b * 2 AS b")) == {(10, 1), (100, 2)}
    assert got(builders.filter_map_query(spark, LEFT, "b > 9", "a")) == {(2, 2)}
    assert got(builders.group_query(spark, LEFT, "b > 1", "a", s=("sum", "b"))) == {(1, 5, 1), (2, 100, 1)}


GOLDEN = {
    "filtering": [{(2, "bob", 40): 1, (3, "ann", 70): 1}, {(4, "bob", 90): 1, (2, "bob", 40): -1}, {(3, "ann", 70): -1}],
    "mapping": [{("ann",): 2, ("bob",): 1}, {}, {}],
    "summing": [{("ann", 75): 1, ("bob", 40): 1}, {("bob", 40): -1, ("bob", 90): 1}, {("ann", 75): -1, ("ann", 12): 1}],
    "distinct": [{("ann",): 1, ("bob",): 1}, {}, {}],
    "pipeline": [{("bob", 80): 1, ("ann", 140): 1}, {("bob", 180): 1, ("bob", 80): -1}, {("ann", 140): -1}],
    "circuit": [{(1, 5): 1, (2, 40): 1, (3, 70): 1}, {(4, 90): 1, (2, 40): -1}, {(3, 70): -1, (1, 5): -1}],
    "sql": [{("ann", 2): 1}, {("bob", 1): 1}, {("ann", 2): -1}],
}


@pytest.mark.parametrize("example", examples.EXAMPLES, ids=lambda f: f.__name__)
def test_examples(spark, example):
    assert example(spark) == GOLDEN[example.__name__]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        use_checkpoints(Session())
