"""Runnable examples: ``python -m deltaweave.examples`` prints what each step changes.

Each function feeds a few deltas and returns the rows and weights that come back, step by step.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from deltaweave.operators.zframe import ZFrame
from deltaweave.plans import incremental as inc
from deltaweave.plans.builders import filter_map_query, filter_query, map_query
from deltaweave.plans.circuit import Circuit
from deltaweave.plans.sqlviews import SqlViews

Steps = list[dict[tuple, int]]
ORDERS = "id long, customer string, amount long"
DELTAS = (
    [((1, "ann", 5), 1), ((2, "bob", 40), 1), ((3, "ann", 70), 1)],
    [((4, "bob", 90), 1), ((2, "bob", 40), -1)],
    [((3, "ann", 70), -1), ((3, "ann", 7), 1)],
)


def _deltas(spark: SparkSession) -> list[ZFrame]:
    return [ZFrame.from_entries(spark, rows, ORDERS) for rows in DELTAS]


def _seen(deltas: list[ZFrame]) -> Steps:
    return [{tuple(r)[:-1]: r["weight"] for r in d.entries().collect()} for d in deltas]


def filtering(spark: SparkSession) -> Steps:
    """Only changes of orders over 30 come out."""
    built = filter_query(spark, ORDERS, "amount > 30")
    return _seen([built.step(d) for d in _deltas(spark)])


def mapping(spark: SparkSession) -> Steps:
    """Rows that become equal add up."""
    built = map_query(spark, ORDERS, "customer")
    return _seen([built.step(d) for d in _deltas(spark)])


def summing(spark: SparkSession) -> Steps:
    """A customer's old sum goes and the new one comes."""
    sums = inc.GroupSums("customer", total=("sum", "amount"))
    return _seen([sums.step(d) for d in _deltas(spark)])


def distinct(spark: SparkSession) -> Steps:
    """A customer appears with the first order and goes with the last."""
    customers = inc.Distinct()
    return _seen([customers.step(d.map("customer")) for d in _deltas(spark)])


def pipeline(spark: SparkSession) -> Steps:
    built = filter_map_query(spark, ORDERS, "amount > 30", "customer", "amount * 2 AS twice")
    return _seen([built.step(d) for d in _deltas(spark)])


def circuit(spark: SparkSession) -> Steps:
    """Two branches of one input, joined again."""
    graph = Circuit(spark)
    orders = graph.input("orders", ORDERS)
    large = orders.filter("amount > 30").map("customer AS who").distinct()
    kept = orders.join(large, "customer", "who", select=["id", "amount"])
    return _seen([graph.step({"orders": d})[kept.node] for d in _deltas(spark)])


def sql(spark: SparkSession) -> Steps:
    views = SqlViews(spark, "CREATE TABLE orders (id BIGINT, customer VARCHAR, amount BIGINT); CREATE VIEW v AS SELECT customer, count(*) AS n FROM orders GROUP BY customer HAVING sum(amount) > 50")
    return _seen([views.step({"orders": d})["v"] for d in _deltas(spark)])


EXAMPLES = (filtering, mapping, summing, distinct, pipeline, circuit, sql)


def main() -> None:
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
    for example in EXAMPLES:
        print(example.__name__)
        for k, changes in enumerate(example(spark)):
            print(f"  step {k}: " + ", ".join(f"{row} {weight:+d}" for row, weight in sorted(changes.items(), key=repr)))
    spark.stop()


if __name__ == "__main__":
    main()
