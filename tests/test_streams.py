"""Streams over logical time."""

from deltaweave.operators.zframe import ZFrame
from deltaweave.streaming.algebra import T, ScalarStream, ZStream, compose


def stream(spark, steps):
    return ZStream.from_steps([ZFrame.from_entries(spark, [((v,), w) for v, w in s], "x long") for s in steps])


def steps(s):
    return [{r.x: r.weight for r in f.entries().collect()} for f in s.steps()]


def test_filter_over_running_sum(spark):
    s = stream(spark, [[(3, 1), (7, 1), (10, 1)], [(8, 1), (2, 1)], [(7, -1), (15, 1)]])
    assert steps(s.filter("x > 5").integrate()) == [{7: 1, 10: 1}, {7: 1, 8: 1, 10: 1}, {8: 1, 10: 1, 15: 1}]


def test_integrate_and_differentiate_are_inverse(spark):
    s = stream(spark, [[(1, 2)], [(1, -2), (2, 1)], [], [(2, 3), (5, -1)]])
    assert steps(s.integrate().differentiate()) == steps(s.differentiate().integrate()) == steps(s)


def test_delay_prepends_nothing(spark):
    s = stream(spark, [[(1, 1)], [(2, 1)]]).delay()
    assert s.length == 3 and steps(s) == [{}, {1: 1}, {2: 1}]


def test_linear_queries_are_their_own_increment(spark):
    s = stream(spark, [[(1, 1), (6, 2)], [(6, -1)], [(9, 1)]])
    assert steps(s.incrementalize(lambda t: t.filter("x > 5"))) == steps(s.filter("x > 5"))


def test_incremental_distinct(spark):
    s = stream(spark, [[(1, 2), (2, 1)], [(1, 1)], [(1, -2)], [(1, -1)]])
    assert steps(s.incrementalize(lambda t: t.distinct())) == [{1: 1, 2: 1}, {}, {}, {1: -1}]


def test_binary_pads_the_shorter(spark):
    a, b = stream(spark, [[(1, 1)], [(2, 1)]]), stream(spark, [[(1, 1)]])
    assert steps(a.lift2(b, lambda x, y: x.unionByName(y))) == [{1: 2}, {2: 1}]
    assert steps(a.subtract(b)) == [{}, {2: 1}]


def test_constant_and_beyond_the_end(spark):
    s = ZStream.constant(ZFrame.from_values(spark, [(4,)], "x long"), 3)
    assert steps(s) == [{4: 1}] * 3 and s.at(9).is_zero()


def numbers(spark, values):
    return ScalarStream(spark.createDataFrame(list(enumerate(values)), f"{T} int, value long"), len(values))


def values(s):
    return [r["value"] for r in s.df.orderBy(T).collect()]


def test_scalars(spark):
    s = numbers(spark, [1, 2, 3, 4])
    assert values(s.integrate()) == [1, 3, 6, 10]
    assert values(s.integrate().differentiate()) == [1, 2, 3, 4]
    assert values(s.delay()) == [0, 1, 2, 3, 4]
    assert values(s.lift2(numbers(spark, [10]), lambda a, b: a + b)) == [11, 2, 3, 4]


def test_doubling_is_linear(spark):
    double = lambda s: ScalarStream(s.df.selectExpr(T, "value * 2 AS value"), s.length)
    s = numbers(spark, [1, 1, 1])
    assert values(compose(ScalarStream.integrate, double, ScalarStream.differentiate)(s)) == [2, 2, 2]
