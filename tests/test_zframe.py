"""Weighted tables: group laws, linearity, distinct, aggregates, joins."""

import pytest
from pyspark.sql import functions as F

from deltaweave.functions.predicates import numeric_mask, position, string_mask
from deltaweave.operators import joins
from deltaweave.operators.zframe import W, ZFrame, weighted_avg, weighted_count, weighted_max, weighted_min, weighted_sum
from deltaweave.sources.schema import infer_schema


def z(spark, entries, schema="x long"):
    return ZFrame.from_entries(spark, [((v,) if not isinstance(v, tuple) else v, w) for v, w in entries], schema)


def entries(frame):
    return {tuple(r)[:-1] if len(r) > 2 else r[0]: r["weight"] for r in frame.entries().collect()}


def test_entries_merge_and_zero_weights_vanish(spark):
    assert entries(z(spark, [(1, 2), (1, 3), (2, 0), (3, 1), (3, -1)])) == {1: 5}


def test_group_laws(spark):
    a, b, c = (z(spark, e) for e in ([(1, 2), (2, -1)], [(2, 3)], [(None, 1), (1, -2)]))
    assert a.add(a.empty()).equals(a)
    assert a.subtract(a).is_zero()
    assert a.add(b).equals(b.add(a))
    assert a.add(b).add(c).equals(a.add(b.add(c)))
    assert a.negate().negate().equals(a)


def test_nulls_are_one_row(spark):
    assert entries(z(spark, [(None, 1), (None, 2)])) == {None: 3}


def test_filter_and_map_are_linear(spark):
    a, b = z(spark, [(1, 2), (7, 1)]), z(spark, [(7, -1), (9, 4)])
    assert a.add(b).filter("x > 5").equals(a.filter("x > 5").add(b.filter("x > 5")))
    assert a.add(b).map("x % 2 AS y").equals(a.map("x % 2 AS y").add(b.map("x % 2 AS y")))


def test_map_collision_adds_weights(spark):
    assert entries(z(spark, [(1, 2), (2, 3)]).map("x % 2 AS y")) == {1: 2, 0: 3}


def test_flat_map_inherits_weight(spark):
    rows = z(spark, [(("a b a",), 2), (("b",), -1)], "s string")
    assert entries(rows.flat_map(F.split("s", " "), "w")) == {"a": 4, "b": 1}


def test_distinct_bag_and_checks(spark):
    a = z(spark, [(1, 3), (2, -1), (3, 1)])
    assert entries(a.distinct()) == {1: 1, 3: 1}
    assert sorted(r.x for r in a.bag().collect()) == [1, 1, 1, 3]
    assert not a.is_positive() and not a.is_set() and a.distinct().is_set()
    assert a.size() == 3 and a.has("x = 2") and not a.has("x = 5") and a.weight("x = 1") == 3


def test_intersect_takes_the_smaller_weight(spark):
    assert entries(z(spark, [(1, 3), (2, 1), (3, -1)]).intersect(z(spark, [(1, 2), (3, 4)]))) == {1: 2}


def test_weighted_aggregates(spark):
    rows = z(spark, [((50.0,), 1), ((100.0,), 2), ((7.0,), -1)], "v double")
    got = rows.reduce(weighted_count().alias("n"), weighted_sum("v").alias("s"), weighted_min("v").alias("lo"), weighted_max("v").alias("hi"), weighted_avg("v").alias("m")).first()
    assert (got.n, got.s, got.lo, got.hi, got.m) == (2, 243.0, 50.0, 100.0, 121.5)
    assert rows.count().first()[0] == 2 and rows.empty().count().first()[0] == 0
    assert rows.empty().sum("v").first()[0] is None


def test_join_multiplies_weights_and_null_keys_do_not_match(spark):
    a = z(spark, [((1, "a"), 2), ((2, "b"), 1), ((None, "n"), 1)], "k long, l string")
    b = z(spark, [((1, "x"), 3), ((1, "y"), -1), ((None, "z"), 1)], "j long, r string")
    assert entries(joins.join(a, b, "k", "j").map("l", "r")) == {("a", "x"): 6, ("a", "y"): -2}
    assert joins.match_counts(a, b, "k", "j").first().pairs == 4
    assert entries(joins.join(a, b, "k", "j", where="r = 'x'", select=["l"])) == {"a": 6}


def test_cartesian_is_bilinear(spark):
    a, b, c = z(spark, [(1, 2)]), z(spark, [(5, 1)], "y long"), z(spark, [(6, -3)], "y long")
    assert joins.cartesian(a, b.add(c)).equals(joins.cartesian(a, b).add(joins.cartesian(a, c)))


def test_semi_and_anti_look_at_positive_rows(spark):
    left = z(spark, [(1, 2), (2, 1), (3, 1)])
    right = z(spark, [((1, 1), 1), ((2, 1), -1), ((3, 1), 1), ((3, 2), -1)], "k long, v long")
    assert entries(joins.semi_join(left, right, "x", "k")) == {1: 2, 3: 1}
    assert entries(joins.anti_join(left, right, "x", "k")) == {2: 1}


@pytest.mark.parametrize(("how", "want"), [("left", {(1, 1), (2, None)}), ("right", {(1, 1), (None, 3)}), ("full", {(1, 1), (2, None), (None, 3)})])
def test_outer_joins_pad_with_null(spark, how, want):
    got = joins.outer_join(z(spark, [(1, 1), (2, 1)]), z(spark, [(1, 1), (3, 1)], "y long"), "x", "y", how)
    assert {tuple(r) for r in got.values().collect()} == want


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="rename"):
        joins.join(z(spark, [(1, 1)]), z(spark, [(1, 1)]), "x", "x")


def prices(spark, rows):
    return spark.createDataFrame(rows, "symbol string, at long, price long")


def trades(spark, rows):
    return spark.createDataFrame(rows, "id long, symbol string, ts long")


@pytest.mark.parametrize(
    ("ts", "quotes", "forward", "want"),
    [(2500, [(1000, 100), (2000, 105), (3000, 110)], False, 105), (1000, [(2000, 100)], False, None), (1000, [(1000, 100)], False, 100), (1500, [(1000, 100), (2000, 105)], True, 105), (1000, [(1000, 7)], True, 7), (3000, [(1000, 7)], True, None)],
)
def test_asof(spark, ts, quotes, forward, want):
    right = prices(spark, [("S", t, p) for t, p in quotes] + [("T", ts, 1)])
    got = joins.asof_join(trades(spark, [(1, "S", ts)]), right, ["symbol"], "ts", "at", ["price"], forward).collect()
    assert [r.price for r in got] == [want]


def test_predicates(spark):
    rows = spark.createDataFrame([("Apple", 1), ("grape_b", 2), ("aXb", 3), (None, None)], "s string, n int")
    assert rows.where(string_mask("s", "like", "a%b")).count() == 1
    assert rows.where(string_mask("s", "like", "a%", ignore_case=True)).count() == 2
    assert rows.where(numeric_mask("n", "between", 2, 3)).count() == 2
    assert rows.where(~string_mask("s", "in", ["aXb"])).count() == 2  # null is neither in nor not in
    assert [r[0] for r in rows.select(position(F.col("s"), ["aXb", "Apple"])).collect()] == [2, 0, 1, None]
    with pytest.raises(ValueError, match="unknown"):
        numeric_mask("n", "~", 1)


def test_inferred_schema():
    got = infer_schema({"a": 1, "b": 1.5, "c": True, "d": "x", "e": None, "f": 2.0})
    assert [f.dataType.simpleString() for f in got.fields] == ["bigint", "double", "boolean", "string", "string", "bigint"]


def test_weight_column_is_required(spark):
    with pytest.raises(ValueError, match=W):
        ZFrame(spark.range(1))
