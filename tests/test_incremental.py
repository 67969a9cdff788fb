"""Incremental operators against batch, golden step sequences, circuits."""

import random

import pytest
from pyspark.sql import functions as F

from deltaweave.operators import joins
from deltaweave.operators.zframe import ZFrame, weighted_count
from deltaweave.plans import incremental as inc
from deltaweave.plans.circuit import Circuit, Collected


def z(spark, entries, schema="x long"):
    return ZFrame.from_entries(spark, [((v,) if not isinstance(v, tuple) else v, w) for v, w in entries], schema)


def entries(frame):
    return {tuple(r)[:-1] if len(r) > 2 else r[0]: r["weight"] for r in frame.entries().collect()}


def test_distinct_deltas(spark):
    op = inc.Distinct()
    steps = [[("a", 2), ("b", 1)], [("a", 1)], [("a", -2)], [("a", -1)]]
    assert [entries(op.step(z(spark, s, "x string"))) for s in steps] == [{"a": 1, "b": 1}, {}, {}, {"a": -1}]


def test_distinct_into_negative(spark):
    op = inc.Distinct()
    assert [entries(op.step(z(spark, [("a", w)], "x string"))) for w in (3, -2, -2)] == [{"a": 1}, {}, {"a": -1}]


def test_pipeline_deltas(spark):
    op = inc.Linear(lambda d: d.filter("x > 0").map("x * 2 AS x"))
    steps = [[(-5, 1), (3, 1), (7, 1)], [(2, 1), (-1, 1)], [(3, -1), (10, 1)]]
    assert [entries(op.step(z(spark, s))) for s in steps] == [{6: 1, 14: 1}, {4: 1}, {6: -1, 20: 1}]


def test_group_sums_drop_empty_groups(spark):
    op, sink = inc.GroupSums("r", s=("sum", "v"), n=("count", None), m=("avg", "v")), Collected()
    for rows in ([(("NA", 100), 1), (("EU", 200), 1)], [(("NA", 50), 1)], [(("EU", 200), -1)]):
        sink(op.step(z(spark, rows, "r string, v long")))
    assert [tuple(r) for r in sink.table.values().collect()] == [("NA", 150, 2, 75.0)]


def test_group_sum_is_null_without_values(spark):
    op = inc.GroupSums("r", s=("sum", "v"), n=("count", "v"), rows=("count", None))
    op.step(z(spark, [((None, 1), 1), ((None, None), 1)], "r string, v long"))
    delta = op.step(z(spark, [((None, 1), -1)], "r string, v long"))
    assert entries(delta) == {(None, 1, 1, 2): -1, (None, None, 0, 1): 1}


def test_join_then_delete_right(spark):
    op, sink = inc.Join("c", "k"), Collected()
    sink(op.step(z(spark, [((1, 7), 1)], "o long, c long"), z(spark, [((7, "n"), 1)], "k long, name string")))
    assert sink.table.size() == 1
    sink(op.step(z(spark, [], "o long, c long"), z(spark, [((7, "n"), -1)], "k long, name string")))
    assert sink.table.is_zero()


def test_append_only_join_refuses_retractions(spark):
    op = inc.AppendOnlyJoin("x", "y")
    op.step(z(spark, [(1, 1)]), z(spark, [(1, 1)], "y long"))
    with pytest.raises(ValueError, match="retraction"):
        op.step(z(spark, [(1, -1)]), z(spark, [], "y long"))


def test_extremes_retract(spark):
    op, sink = inc.extremes("g", lo=("min", "v"), hi=("max", "v")), Collected()
    sink(op.step(z(spark, [((1, 0), 1), ((1, 5), 2), ((2, 9), 1)], "g long, v long")))
    sink(op.step(z(spark, [((1, 0), -1), ((2, 9), -1), ((1, 5), -1)], "g long, v long")))
    assert [tuple(r) for r in sink.table.values().collect()] == [(1, 5, 5)]


def test_update_of_one_row_is_not_cancelled(spark):
    """Rows are identified whole, so an update of a key leaves the new row."""
    delta = z(spark, [((1, "old"), -1), ((1, "new"), 1)], "id long, v string")
    assert entries(delta) == {(1, "old"): -1, (1, "new"): 1}


BUILDERS = {
    "join": (lambda: inc.Join("a", "k"), lambda a, b: joins.join(a, b, "a", "k")),
    "semi": (lambda: inc.semi_join("a", "k"), lambda a, b: joins.semi_join(a, b, "a", "k")),
    "anti": (lambda: inc.anti_join("a", "k"), lambda a, b: joins.anti_join(a, b, "a", "k")),
    "left": (lambda: inc.outer_join("a", "k", "left"), lambda a, b: joins.outer_join(a, b, "a", "k", "left")),
    "full": (lambda: inc.outer_join("a", "k", "full"), lambda a, b: joins.outer_join(a, b, "a", "k", "full")),
}


@pytest.mark.parametrize("name", BUILDERS)
def test_incremental_equals_batch(spark, name):
    """Random deltas with retractions and null keys, compared with the batch at the end."""
    make, batch = BUILDERS[name]
    rng = random.Random(name)
    op, sink = make(), Collected()
    total: list[dict] = [{}, {}]
    schemas = ("a long, b long", "k long, v long")
    for _ in range(3):
        deltas = []
        for side in (0, 1):
            change: dict = {}
            for _ in range(8):
                row = (rng.choice([None, 1, 2, 3, 4]), rng.randint(0, 2))
                w = -1 if total[side].get(row, 0) + change.get(row, 0) > 0 and rng.random() < 0.5 else 1
                change[row] = change.get(row, 0) + w
            for row, w in change.items():
                total[side][row] = total[side].get(row, 0) + w
            deltas.append(z(spark, change.items(), schemas[side]))
        sink(op.step(*deltas))
    assert sink.table.equals(batch(*(z(spark, t.items(), s) for t, s in zip(total, schemas, strict=True))))


def test_pruned_join(spark):
    op = inc.PrunedJoin("c", "k", "t", "u", 100)
    sink = Collected()
    sink(op.step(z(spark, [], "o long, c long, t long"), z(spark, [((i, 0), 1) for i in range(10)], "k long, u long")))
    sink(op.step(z(spark, [((1, 3, 500), 1)], "o long, c long, t long"), z(spark, [], "k long, u long")))
    assert op.pruned == [0, 10] and sink.table.is_zero()


def test_circuit_shares_nodes_and_keeps_equal_filters_apart(spark):
    circuit, low, high = Circuit(spark), Collected(), Collected()
    numbers = circuit.input("n", "x long")
    numbers.filter("x < 5").output(low)
    numbers.filter("x >= 5").output(high)
    circuit.step({"n": z(spark, [(1, 1), (7, 1)])})
    circuit.step({})  # nothing is applied again
    assert entries(low.table) == {1: 1} and entries(high.table) == {7: 1} and circuit.steps == 2
    with pytest.raises(KeyError):
        circuit.step({"m": z(spark, [])})


def test_circuit_integrate_differentiate_delay_reset(spark):
    circuit = Circuit(spark)
    x = circuit.input("n", "x long")
    i, d, late = x.integrate(), x.integrate().differentiate(), x.delay()
    first = circuit.step({"n": z(spark, [(1, 1)])})
    second = circuit.step({"n": z(spark, [(1, 1), (2, 1)])})
    assert entries(second[i.node]) == {1: 2, 2: 1} and entries(second[d.node]) == {1: 1, 2: 1}
    assert first[late.node].is_zero() and entries(second[late.node]) == {1: 1}
    circuit.reset()
    assert entries(circuit.step({"n": z(spark, [(9, 1)])})[i.node]) == {9: 1}


def test_chain_rule(spark):
    """D(Q2(Q1(I))) equals the chain of the incremental forms."""

    def q1(t):
        return t.distinct()

    def q2(t):
        return ZFrame.of(t.df.groupBy((F.col("x") % 2).alias("p")).agg(weighted_count().alias("n")))

    whole, first, second = inc.Incrementalized(lambda t: q2(q1(t))), inc.Incrementalized(q1), inc.Incrementalized(q2)
    for step in ([(1, 1), (2, 2)], [(3, 1), (2, -2)], [(1, -1)]):
        delta = z(spark, step)
        assert whole.step(delta).equals(second.step(first.step(delta)))


def test_segments_merge_by_levels(spark):
    integral = inc.Integral()
    integral.segments.fan = 2
    for k in range(8):
        integral.step(z(spark, [(k % 3, 1), (9, 1 if k % 2 == 0 else -1)]))
    assert [len(level) for level in integral.segments.levels] == [2, 2]
    assert entries(integral.state) == {0: 3, 1: 3, 2: 2}
