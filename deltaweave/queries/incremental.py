"""Incremental queries: deltas with retractions step by step; the SQL is the final batch query.

Each query feeds three deltas (keys by last digit: 0-6; then 7, 8 and not 3; then 9, 3 again and
not 5) and returns the sum of the deltas it got back, so every retraction counts.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.operators import joins
from deltaweave.operators.zframe import ZFrame, weighted_count, weighted_sum
from deltaweave.plans import incremental as inc
from deltaweave.plans.builders import filter_map_query
from deltaweave.plans.circuit import Circuit, Collected
from deltaweave.plans.sqlviews import SqlViews
from deltaweave.queries.registry import cents, query, table
from deltaweave.session import cut, use_checkpoints
from deltaweave.sources.feeds import Feed, dump, load
from deltaweave.sources.keyed import KeyedTable, current_rows, last_changes, log_to_weights, residue_steps
from deltaweave.sources.schema import infer_schema
from deltaweave.streaming.algebra import T, ScalarStream, ZStream, compose
from deltaweave.streaming.progress import Progress
from deltaweave.streaming.runtime import MaintainedViews, Seen, as_timestamps, drop_stale, first_by_id, in_batches, interval_join, keep_newest, keep_oldest


def run_steps(operator, *inputs: list[ZFrame]) -> ZFrame:
    """All deltas through an operator; the sum of what comes back."""
    sink = Collected()
    for deltas in zip(*inputs, strict=True):
        sink(operator.step(*deltas))
    return sink.table


def _orders(spark, sf, *columns: str) -> list[ZFrame]:
    return residue_steps(table(spark, sf, "orders").select("o_orderkey", *columns), "o_orderkey")


def _customers(spark, sf, *columns: str) -> list[ZFrame]:
    return residue_steps(table(spark, sf, "customer").select("c_custkey", *columns), "c_custkey")


_O = "(SELECT * FROM orders WHERE o_orderkey % 10 <> 5)"
_C = "(SELECT * FROM customer WHERE c_custkey % 10 <> 5)"


@query("incr_filter_map", f"SELECT o_custkey, CAST(count(*) AS BIGINT) AS weight FROM {_O} WHERE o_totalprice > 150000 GROUP BY 1")
def incr_filter_map(spark, sf):
    op = inc.Linear(lambda d: d.filter("o_totalprice > 150000").map("o_custkey"))
    return run_steps(op, _orders(spark, sf, "o_custkey", "o_totalprice")).entries()


@query("incr_distinct", f"SELECT DISTINCT o_custkey, o_orderstatus FROM {_O}")
def incr_distinct(spark, sf):
    steps = [d.map("o_custkey", "o_orderstatus") for d in _orders(spark, sf, "o_custkey", "o_orderstatus")]
    return run_steps(inc.Distinct(), steps).values()


@query("incr_join", f"SELECT o_orderkey, c_custkey, c_mktsegment FROM {_O} JOIN {_C} ON o_custkey = c_custkey")
def incr_join(spark, sf):
    out = run_steps(inc.Join("o_custkey", "c_custkey"), _orders(spark, sf, "o_custkey"), _customers(spark, sf, "c_mktsegment"))
    return out.map("o_orderkey", "c_custkey", "c_mktsegment").bag()


@query("incr_join_append", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def incr_join_append(spark, sf):
    orders, customers = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    left = [ZFrame.of(orders.where(f"o_orderkey % 3 = {k}")) for k in range(3)]
    right = [ZFrame.of(customers.where(f"c_custkey % 3 = {k}")) for k in range(3)]
    return run_steps(inc.AppendOnlyJoin("o_custkey", "c_custkey"), left, right).map("o_orderkey", "c_mktsegment").bag()


@query("incr_join_filter_map", f"SELECT o_orderkey, c_name, o_totalprice > 200000 AS large FROM {_O} JOIN {_C} ON o_custkey = c_custkey WHERE c_acctbal * 20 > o_totalprice")
def incr_join_filter_map(spark, sf):
    op = inc.Join("o_custkey", "c_custkey", "c_acctbal * 20 > o_totalprice", ["o_orderkey", "c_name", "o_totalprice > 200000 AS large"])
    return run_steps(op, _orders(spark, sf, "o_custkey", "o_totalprice"), _customers(spark, sf, "c_name", "c_acctbal")).bag()


@query("incr_semi", f"SELECT o_orderkey, o_custkey FROM {_O} WHERE o_custkey IN (SELECT c_custkey FROM {_C} WHERE c_acctbal > 0)")
def incr_semi(spark, sf):
    customers = [d.filter("c_acctbal > 0") for d in _customers(spark, sf, "c_acctbal")]
    return run_steps(inc.semi_join("o_custkey", "c_custkey"), _orders(spark, sf, "o_custkey"), customers).bag()


@query("incr_anti", f"SELECT o_orderkey, o_custkey FROM {_O} WHERE o_custkey NOT IN (SELECT c_custkey FROM {_C} WHERE c_acctbal > 0)")
def incr_anti(spark, sf):
    customers = [d.filter("c_acctbal > 0") for d in _customers(spark, sf, "c_acctbal")]
    return run_steps(inc.anti_join("o_custkey", "c_custkey"), _orders(spark, sf, "o_custkey"), customers).bag()


def _outer(how):
    def run(spark, sf):
        customers = [d.filter("c_acctbal > 0").map("c_custkey", "c_mktsegment") for d in _customers(spark, sf, "c_acctbal", "c_mktsegment")]
        return run_steps(inc.outer_join("o_custkey", "c_custkey", how), _orders(spark, sf, "o_custkey"), customers).map("o_orderkey", "c_custkey", "c_mktsegment").bag()

    return run


for _how in ("left", "right", "full"):
    query(f"incr_{_how}", f"SELECT o_orderkey, c_custkey, c_mktsegment FROM {_O} {_how.upper()} JOIN (SELECT * FROM {_C} WHERE c_acctbal > 0) ON o_custkey = c_custkey")(_outer(_how))


@query("incr_group_sums", f"SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, count(p) AS n_known, CAST(sum(CAST(p AS DECIMAL(18,2))) AS DOUBLE) AS s_known FROM (SELECT *, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS p FROM {_O}) GROUP BY 1")
def incr_group_sums(spark, sf):
    steps = [d.map("o_custkey", cents("o_totalprice").alias("v"), F.when(F.col("o_totalprice") > 100000, cents("o_totalprice")).alias("p")) for d in _orders(spark, sf, "o_custkey", "o_totalprice")]
    out = run_steps(inc.GroupSums("o_custkey", s=("sum", "v"), n=("count", None), mean=("avg", "v"), n_known=("count", "p"), s_known=("sum", "p")), steps)
    return out.bag().withColumns({"s": F.col("s").cast("double"), "s_known": F.col("s_known").cast("double")})


def _pruned_sides(spark, sf) -> tuple[list[ZFrame], list[ZFrame]]:
    """Purchases and clicks in three deltas by time."""
    events = as_timestamps(table(spark, sf, "events")).withColumn("at", F.unix_micros("ts"))
    edges = events.selectExpr("percentile(at, array(0.34, 0.67)) AS q").first()["q"]
    cuts = [-(2**62), *(int(x) for x in edges), 2**62]
    left, right = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = events.where((F.col("at") >= a) & (F.col("at") < b))
        left.append(ZFrame.of(part.where("event_type = 'purchase'").select("event_id", "user_id", F.col("at").alias("p_at"))))
        right.append(ZFrame.of(part.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("c_user"), F.col("at").alias("c_at"))))
    return left, right


@query("incr_group_sums_steps", "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey % 25 <> 24 GROUP BY 1")
def incr_group_sums_steps(spark, sf):
    """25 steps: each brings a 25th of the orders doubled in price and takes back the doubled ones
    of the step before, whose plain prices it brings; logs merge several times on the way."""
    orders = cut(table(spark, sf, "orders").select("o_custkey", "o_orderkey", cents("o_totalprice").alias("v")))
    op, sink = inc.GroupSums("o_custkey", s=("sum", "v"), n=("count", None), keys=("sum", "o_orderkey")), Collected()
    for k in range(25):
        new, old = (orders.where(F.pmod("o_orderkey", F.lit(25)) == t).withColumn("v", (F.col("v") * 2).cast("decimal(18,2)")) for t in (k, k - 1))
        plain = orders.where(F.pmod("o_orderkey", F.lit(25)) == k - 1)
        sink(op.step(ZFrame.of(new).add(ZFrame.of(old, -1)).add(ZFrame.of(plain))))
    sink(op.step(ZFrame.of(new, -1)))  # the last ones go
    return sink.table.bag().withColumn("s", F.col("s").cast("double"))


@query("incr_delay", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 IN (0, 1, 2, 4, 5, 6, 7, 8)")
def incr_delay(spark, sf):
    """A step late, so the third delta has not come out yet."""
    return run_steps(inc.Delay(), _orders(spark, sf, "o_custkey")).map("o_orderkey", "o_custkey").bag()


@query("incr_pruned_memory", "WITH e AS (SELECT event_type, epoch_us(ts) AS us FROM events WHERE event_type IN ('purchase', 'click')), m AS (SELECT max(us) FILTER (WHERE event_type = 'purchase') AS p, max(us) FILTER (WHERE event_type = 'click') AS c FROM e) SELECT count(*) FILTER (WHERE event_type = 'purchase' AND us >= c - 259200000000) AS left_rows, count(*) FILTER (WHERE event_type = 'click' AND us >= p - 259200000000) AS right_rows, count(*) FILTER (WHERE event_type = 'purchase' AND us < c - 259200000000) AS left_pruned, count(*) FILTER (WHERE event_type = 'click' AND us < p - 259200000000) AS right_pruned FROM e, m")
def incr_pruned_memory(spark, sf):
    op = inc.PrunedJoin("user_id", "c_user", "p_at", "c_at", 259_200_000_000)
    for deltas in zip(*_pruned_sides(spark, sf), strict=True):
        op.step(*deltas)
    memory = op.memory()
    return spark.createDataFrame([memory], "left_rows long, right_rows long, left_pruned long, right_pruned long")


@query("incr_minmax", f"SELECT o_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM {_O} GROUP BY 1")
def incr_minmax(spark, sf):
    return run_steps(inc.extremes("o_custkey", lo=("min", "o_totalprice"), hi=("max", "o_totalprice")), _orders(spark, sf, "o_custkey", "o_totalprice")).bag()


@query("incr_topk", f"SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {_O}) WHERE r <= 2")
def incr_topk(spark, sf):
    op = inc.top_k("o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)
    return run_steps(op, _orders(spark, sf, "o_custkey", "o_totalprice")).map("o_custkey", "o_orderkey", "o_totalprice").bag()


@query("incr_generic", f"SELECT o_custkey, count(*) AS n FROM {_O} GROUP BY 1 HAVING count(*) > 9")
def incr_generic(spark, sf):
    op = inc.Incrementalized(lambda z: ZFrame.of(z.df.groupBy("o_custkey").agg(weighted_count().alias("n")).where("n > 9")))
    return run_steps(op, _orders(spark, sf, "o_custkey")).bag()


@query("incr_pruned_join", "WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT * FROM events WHERE event_type = 'click') SELECT p.event_id, c.event_id AS click_id FROM p JOIN c ON p.user_id = c.user_id WHERE epoch_us(p.ts) >= (SELECT max(epoch_us(ts)) FROM c) - 259200000000 AND epoch_us(c.ts) >= (SELECT max(epoch_us(ts)) FROM p) - 259200000000")
def incr_pruned_join(spark, sf):
    return run_steps(inc.PrunedJoin("user_id", "c_user", "p_at", "c_at", 259_200_000_000), *_pruned_sides(spark, sf)).map("event_id", "click_id").bag()


# -- circuits and SQL views ------------------------------------------------------------


@query("circuit_pipeline", f"SELECT c_mktsegment, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS n FROM {_O} JOIN {_C} ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1")
def circuit_pipeline(spark, sf):
    circuit, sink = Circuit(spark), Collected()
    orders, customers = _orders(spark, sf, "o_custkey", "o_orderstatus", "o_totalprice"), _customers(spark, sf, "c_mktsegment")
    o, c = circuit.input("orders", orders[0].schema), circuit.input("customer", customers[0].schema)
    priced = o.filter("o_orderstatus = 'O'").map("o_custkey", cents("o_totalprice").alias("v"))
    priced.join(c, "o_custkey", "c_custkey", select=["c_mktsegment", "v"]).group_sums("c_mktsegment", revenue=("sum", "v"), n=("count", None)).output(sink)
    for d, e in zip(orders, customers, strict=True):
        circuit.step({"orders": d, "customer": e})
    circuit.step({})  # missing inputs have empty deltas
    return sink.table.bag().withColumn("revenue", F.col("revenue").cast("double"))


@query("circuit_multi_view", f"SELECT 'big' AS view, count(*) AS n FROM {_O} WHERE o_totalprice > 200000 UNION ALL SELECT 'small', count(*) FROM {_O} WHERE o_totalprice < 50000 UNION ALL SELECT 'status', count(DISTINCT o_orderstatus) FROM {_O}")
def circuit_multi_view(spark, sf):
    circuit, sinks = Circuit(spark), {n: Collected() for n in ("big", "small", "status")}
    steps = _orders(spark, sf, "o_orderstatus", "o_totalprice")
    orders = circuit.input("orders", steps[0].schema)
    orders.filter("o_totalprice > 200000").output(sinks["big"])
    orders.filter("o_totalprice < 50000").output(sinks["small"])
    orders.map("o_orderstatus").distinct().output(sinks["status"])
    for d in steps:
        circuit.step({"orders": d})
    parts = [s.table.reduce(weighted_count().alias("n")).select(F.lit(n).alias("view"), "n") for n, s in sinks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("circuit_count_sum", f"SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {_O} WHERE o_orderstatus = 'O'")
def circuit_count_sum(spark, sf):
    circuit, n, total = Circuit(spark), Collected(), Collected()
    steps = _orders(spark, sf, "o_orderstatus", "o_totalprice")
    priced = circuit.input("orders", steps[0].schema).filter("o_orderstatus = 'O'").map(cents("o_totalprice").alias("v"))
    priced.count().output(n)
    priced.sum("v", "total").output(total)
    for d in steps:
        circuit.step({"orders": d})
    return n.table.bag().withColumnRenamed("count", "n").crossJoin(total.table.bag().withColumn("total", F.col("total").cast("double")))


@query("circuit_integrate_differentiate", f"SELECT o_custkey, CAST(count(*) AS BIGINT) AS weight FROM {_O} GROUP BY 1")
def circuit_integrate_differentiate(spark, sf):
    circuit, sink = Circuit(spark), Collected()
    steps = [d.map("o_custkey") for d in _orders(spark, sf, "o_custkey")]
    circuit.input("orders", steps[0].schema).integrate().differentiate().output(sink)
    for d in steps:
        circuit.step({"orders": d})
    return sink.table.entries()


@query("built_filter_map", f"SELECT o_custkey, CAST(count(*) AS BIGINT) AS weight FROM {_O} WHERE o_totalprice > 150000 GROUP BY 1")
def built_filter_map(spark, sf):
    steps = _orders(spark, sf, "o_custkey", "o_totalprice")
    built, sink = filter_map_query(spark, steps[0].schema, "o_totalprice > 150000", "o_custkey"), Collected()
    built.output.output(sink)
    for d in steps:
        built.step(d)
    return sink.table.entries()


_SCRIPT = """
CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT, o_orderstatus VARCHAR(1), o_totalprice DOUBLE);
CREATE TABLE customer (c_custkey BIGINT, c_mktsegment VARCHAR(20));
CREATE VIEW open_orders AS SELECT o_orderkey, o_custkey, round(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'O' AND 'a;b' <> o_orderstatus;
CREATE VIEW by_segment AS SELECT c.c_mktsegment, count(*) AS n, max(o.price) AS hi FROM open_orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment HAVING count(*) > 1;
CREATE VIEW lonely AS SELECT c_custkey FROM customer LEFT JOIN open_orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL
"""


def _script(spark, sf) -> SqlViews:
    views = SqlViews(spark, _SCRIPT)
    for d, e in zip(_orders(spark, sf, "o_custkey", "o_orderstatus", "o_totalprice"), _customers(spark, sf, "c_mktsegment"), strict=True):
        views.step({"orders": d, "customer": e})
    return views


@query("sql_view_linear", f"SELECT o_orderkey, o_custkey, round(o_totalprice) AS price FROM {_O} WHERE o_orderstatus = 'O'")
def sql_view_linear(spark, sf):
    return _script(spark, sf).table("open_orders").bag()


@query("sql_view_join_group", f"SELECT c_mktsegment, count(*) AS n, max(round(o_totalprice)) AS hi FROM {_O} JOIN {_C} ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) > 1")
def sql_view_join_group(spark, sf):
    return _script(spark, sf).table("by_segment").bag()


@query("sql_view_outer", f"SELECT c_custkey FROM {_C} WHERE c_custkey NOT IN (SELECT o_custkey FROM {_O} WHERE o_orderstatus = 'O')")
def sql_view_outer(spark, sf):
    return _script(spark, sf).table("lonely").bag()


# -- streams over logical time ---------------------------------------------------------

_STEPS = 6
_EVENTS = f"(SELECT event_type, CAST(user_id % 20 AS BIGINT) AS u, CAST(event_id % {_STEPS} AS INTEGER) AS t, CASE WHEN event_id % 5 = 0 THEN -1 ELSE 1 END AS w FROM events)"


def _stream(spark, sf) -> ZStream:
    events = table(spark, sf, "events").select("event_type", (F.col("user_id") % 20).alias("u"), "event_id")
    stream = ZStream.of(events, f"event_id % {_STEPS}", _STEPS, F.when(F.col("event_id") % 5 == 0, -1).otherwise(1))
    return ZStream(stream.df.drop("event_id"), _STEPS)


def _plain(stream: ZStream) -> DataFrame:
    return stream.consolidate().df.withColumnsRenamed({T: "t", "__w": "weight"})


_INTEGRAL = f"SELECT event_type, u, t, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT e.event_type, e.u, CAST(s.t AS INTEGER) AS t, e.w FROM {_EVENTS} e JOIN generate_series(0, {_STEPS - 1}) s(t) ON e.t <= s.t) GROUP BY ALL HAVING sum(w) <> 0"


@query("stream_integrate", _INTEGRAL)
def stream_integrate(spark, sf):
    return _plain(_stream(spark, sf).integrate())


@query("stream_differentiate", f"SELECT event_type, u, t, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT event_type, u, t, w FROM {_EVENTS} UNION ALL SELECT event_type, u, CAST(t + 1 AS INTEGER), -w FROM {_EVENTS} WHERE t < {_STEPS - 1}) GROUP BY ALL HAVING sum(w) <> 0")
def stream_differentiate(spark, sf):
    return _plain(_stream(spark, sf).differentiate())


@query("stream_delay", f"SELECT event_type, u, CAST(t + 1 AS INTEGER) AS t, CAST(sum(w) AS BIGINT) AS weight FROM {_EVENTS} GROUP BY ALL HAVING sum(w) <> 0")
def stream_delay(spark, sf):
    return _plain(_stream(spark, sf).delay())


@query("stream_roundtrip", f"SELECT event_type, u, t, CAST(sum(w) AS BIGINT) AS weight FROM {_EVENTS} GROUP BY ALL HAVING sum(w) <> 0")
def stream_roundtrip(spark, sf):
    return _plain(_stream(spark, sf).integrate().differentiate())


@query("stream_lift2", f"SELECT event_type, u, t, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT event_type, u, t, w FROM {_EVENTS} WHERE event_type <> 'view' UNION ALL SELECT event_type, u, CAST(t + 1 AS INTEGER), w FROM {_EVENTS} WHERE event_type = 'view') GROUP BY ALL HAVING sum(w) <> 0")
def stream_lift2(spark, sf):
    stream = _stream(spark, sf)
    return _plain(stream.filter("event_type <> 'view'").lift2(stream.filter("event_type = 'view'").delay(), lambda a, b: a.unionByName(b)))


@query(
    "stream_incrementalize",
    f"WITH i AS ({_INTEGRAL}), d AS (SELECT event_type, u, t FROM i WHERE weight > 0) SELECT event_type, u, t, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT event_type, u, t, 1 AS w FROM d UNION ALL SELECT event_type, u, CAST(t + 1 AS INTEGER), -1 FROM d WHERE t < {_STEPS - 1}) GROUP BY ALL HAVING sum(w) <> 0",
)
def stream_incrementalize(spark, sf):
    return _plain(_stream(spark, sf).incrementalize(lambda s: s.distinct()))


@query("stream_compose", f"WITH i AS ({_INTEGRAL}) SELECT event_type, u, t, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT event_type, u, t, weight AS w FROM i WHERE u < 10 UNION ALL SELECT event_type, u, CAST(t + 1 AS INTEGER), -weight FROM i WHERE u < 10 AND t < {_STEPS - 1}) GROUP BY ALL HAVING sum(w) <> 0")
def stream_compose(spark, sf):
    return _plain(compose(ZStream.integrate, lambda s: s.filter("u < 10"), ZStream.differentiate)(_stream(spark, sf)))


@query("stream_lifted_aggregate", f"SELECT t, CAST(sum(w) AS BIGINT) AS n, CAST(sum(w * u) AS BIGINT) AS s FROM {_EVENTS} GROUP BY 1")
def stream_lifted_aggregate(spark, sf):
    return _stream(spark, sf).aggregate(weighted_count().alias("n"), weighted_sum("u").alias("s")).withColumnRenamed(T, "t")


@query("stream_scalar_integral", f"SELECT t, CAST(sum(s) OVER (ORDER BY t) AS BIGINT) AS value, CAST(s - lag(s, 1, 0) OVER (ORDER BY t) AS BIGINT) AS change FROM (SELECT t, sum(w * u) AS s FROM {_EVENTS} GROUP BY 1)")
def stream_scalar_integral(spark, sf):
    numbers = ScalarStream(_stream(spark, sf).aggregate(weighted_sum("u").alias("value")), _STEPS)
    change = numbers.differentiate().df.withColumnRenamed("value", "change")
    return numbers.integrate().df.join(change, T).withColumnRenamed(T, "t")


# -- keyed tables and change logs ------------------------------------------------------

_LOG = "(SELECT user_id, event_type, value, event_id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op FROM events)"
_LAST = f"(SELECT * FROM {_LOG} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"


def _log(spark, sf) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return table(spark, sf, "events").select("user_id", "event_type", "value", "event_id", op.alias("op"))


@query("cdc_last_wins", f"SELECT user_id, event_type, value FROM {_LAST} WHERE op <> 'delete'")
def cdc_last_wins(spark, sf):
    return current_rows(_log(spark, sf), "user_id", "op", "event_id")


@query("cdc_weights", f"SELECT user_id, event_type, value, CAST(1 AS BIGINT) AS weight FROM {_LAST} WHERE op <> 'delete'")
def cdc_weights(spark, sf):
    return log_to_weights(_log(spark, sf), "user_id", "op", "event_id").entries()


@query("cdc_apply", f"SELECT user_id, event_type, value FROM {_LAST} WHERE op <> 'delete'")
def cdc_apply(spark, sf):
    log = _log(spark, sf)
    rows = KeyedTable(spark, log.select("user_id", "event_type", "value").schema, "user_id")
    sink = Collected()
    middle = log.agg(F.max("event_id") / 2).first()[0]
    for part in (log.where(F.col("event_id") <= middle), log.where(F.col("event_id") > middle)):
        sink(rows.apply(part, "op", "event_id"))
    return sink.table.bag()


@query("upsert_remove_where", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AND o_orderstatus <> 'F'")
def upsert_remove_where(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    rows, sink = KeyedTable(spark, orders.schema, "o_custkey"), Collected()
    middle = orders.agg(F.max("o_orderkey") / 2).first()[0]
    sink(rows.push(orders.where(F.col("o_orderkey") <= middle), "o_orderkey"))
    sink(rows.push(orders.where(F.col("o_orderkey") > middle), "o_orderkey"))
    sink(rows.remove_where("o_orderstatus = 'F'"))
    return sink.table.bag()


@query("keyed_insert_many_update", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 3")
def keyed_insert_many_update(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    rows = KeyedTable(spark, customers.schema, "c_custkey")
    rows.insert(customers.where("c_custkey % 3 = 0"))
    rows.insert_many(customers.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "never").otherwise(F.col("c_mktsegment"))))
    rows.update("c_custkey % 2 = 0", c_mktsegment=F.lit("even"))
    rows.remove(customers.where("c_custkey % 7 = 3"))
    return rows.rows


# -- ingestion -------------------------------------------------------------------------


@query("dedup_message_id", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def dedup_message_id(spark, sf):
    return first_by_id(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("dedup_across_batches", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def dedup_across_batches(spark, sf):
    """Three batches by event id; an id met in an earlier batch does not pass again."""
    events, seen, sink = table(spark, sf, "events").select("user_id", "event_id"), Seen("user_id", "event_id"), Collected()
    edges = [int(x) for x in events.selectExpr("percentile(event_id, array(0.2, 0.7)) AS q").first()["q"]]
    cuts = [-(2**62), *edges, 2**62]
    for a, b in zip(cuts, cuts[1:], strict=False):
        sink(ZFrame.of(seen(events.where((F.col("event_id") > a) & (F.col("event_id") <= b)))))
    return sink.table.bag()


@query("zset_zero_insert", "SELECT n_nationkey, n_name, CAST(3 AS BIGINT) AS weight FROM nation")
def zset_zero_insert(spark, sf):
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return ZFrame.zero(spark, nations.schema).insert(nations, 2).insert(nations).entries()


@query("zset_map_batches", "SELECT c_custkey, upper(c_mktsegment) AS segment, CAST(1 AS BIGINT) AS weight FROM customer")
def zset_map_batches(spark, sf):
    def shout(batches):
        for batch in batches:
            batch["segment"] = batch["c_mktsegment"].str.upper()
            yield batch[["c_custkey", "segment", "__w"]]

    customers = ZFrame.of(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))
    return customers.map_batches(shout, "c_custkey long, segment string, __w long").entries()


@query("dump_infer_load", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def dump_infer_load(spark, sf):
    folder = _folder(spark)
    dump(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), folder)
    return load(spark, folder, infer_schema({"c_custkey": 1, "c_mktsegment": "x", "c_acctbal": 0.5}))


@query("feed_controlled", "SELECT i AS order_id, CAST(i % 7 AS BIGINT) AS customer_id, CASE WHEN i < 100 THEN 0 WHEN i < 150 THEN 1 WHEN i < 450 THEN 2 WHEN i < 500 THEN 4 ELSE 5 END AS tick FROM generate_series(0, 519) t(i)")
def feed_controlled(spark, sf):
    """A snapshot of 100, 50 a tick, a burst of 250 beside it, a pause, and 20 a tick."""
    feed = Feed(lambda ids: ids.selectExpr("id AS order_id", "id % 7 AS customer_id"), spark, rate=50)
    parts = [feed.snapshot(100), feed.tick()]
    feed.burst(250)
    parts.append(feed.tick())
    feed.pause()
    parts.append(feed.tick())
    feed.resume()
    parts.append(feed.tick())
    feed.rate = 20
    parts.append(feed.tick())
    tagged = [p.withColumn("tick", F.lit(k)) for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged)


@query("join_statistics", "SELECT (SELECT count(*) FROM orders) AS build_rows, (SELECT count(*) FROM customer) AS probe_rows, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS pairs")
def join_statistics(spark, sf):
    orders, seen = joins.observed(ZFrame.of(table(spark, sf, "orders").select("o_orderkey", "o_custkey")), "orders")
    customers, met = joins.observed(ZFrame.of(table(spark, sf, "customer").select("c_custkey")), "customer")
    pairs = joins.join(orders, customers, "o_custkey", "c_custkey").df.count()
    return spark.createDataFrame([(seen.get["rows"], met.get["rows"], pairs)], "build_rows long, probe_rows long, pairs long")


@query("stream_progress", "SELECT count(*) AS rows FROM events")
def stream_progress(spark, sf):
    """Rows that a listener has counted over all batches of a stream."""
    folder, listener = _folder(spark), Progress()
    spark.streams.addListener(listener)
    try:
        stream = in_batches(_event_stream(spark, sf), lambda batch, batch_id: batch.write.format("noop").mode("overwrite").save(), f"{folder}/checkpoint")
        stream.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.createDataFrame([(int(listener.stats(stream.id)["rows"]),)], "rows long")
    finally:
        spark.streams.removeListener(listener)


@query("freshness_last_n", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500")
def freshness_last_n(spark, sf):
    return keep_newest(table(spark, sf, "events").select("event_id"), "event_id", 500)


@query("overflow_first_n", "SELECT event_id FROM events ORDER BY event_id LIMIT 500")
def overflow_first_n(spark, sf):
    return keep_oldest(table(spark, sf, "events").select("event_id"), "event_id", 500)


@query("freshness_max_age", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def freshness_max_age(spark, sf):
    events = table(spark, sf, "events")
    return drop_stale(events, "ts", "2 DAYS", F.lit(events.agg(F.max("ts")).first()[0])).select("event_id")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 4).parquet(sf)


def _folder(spark: SparkSession) -> str:
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


@query("stream_views", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY 1")
def stream_views(spark, sf):
    folder = _folder(spark)
    circuit = Circuit(spark)
    source = circuit.input("events", table(spark, sf, "events").select("event_id", "event_type", "value").schema)
    views = MaintainedViews(circuit, "events", lambda b: ZFrame.of(b.select("event_id", "event_type", "value")), f"{folder}/out")
    views.view("counts", source.map("event_type", "CASE WHEN value > 50 THEN 1 END AS high").group_sums("event_type", n=("count", None), high=("count", "high")))
    in_batches(_event_stream(spark, sf), views.process, f"{folder}/checkpoint").awaitTermination()
    return views.current("counts").bag()


@query("stream_windowed", "SELECT CAST(strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed(spark, sf):
    folder = _folder(spark)
    windowed = as_timestamps(_event_stream(spark, sf)).withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n").write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    windowed.writeStream.outputMode("update").foreachBatch(process).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return last_changes(out, ["day", "event_type"], "batch").drop("batch")


@query("stream_interval_join", "SELECT p.event_id, c.event_id AS click_id FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts + INTERVAL 6 HOUR WHERE p.event_type = 'purchase' AND c.event_type = 'click'")
def stream_interval_join(spark, sf):
    folder = _folder(spark)
    events = as_timestamps(_event_stream(spark, sf))
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("c_user"), F.col("ts").alias("c_ts"))
    joined = interval_join(left, right, ("user_id", "c_user"), ("ts", "c_ts"), "6 HOURS", "1 day").select("event_id", "click_id")
    joined.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("join_equals_batch", f"SELECT count(*) AS n FROM {_O} JOIN {_C} ON o_custkey = c_custkey")
def join_equals_batch(spark, sf):
    """Incremental minus batch is empty; the count is the batch's."""
    orders, customers = _orders(spark, sf, "o_custkey"), _customers(spark, sf, "c_mktsegment")
    stepped = run_steps(inc.Join("o_custkey", "c_custkey"), orders, customers)
    whole = joins.join(orders[0].add(orders[1]).add(orders[2]), customers[0].add(customers[1]).add(customers[2]), "o_custkey", "c_custkey")
    if not stepped.equals(whole):
        raise AssertionError("the incremental join differs from the batch join")
    return stepped.reduce(weighted_count().alias("n"))
