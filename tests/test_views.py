"""SQL scripts, keyed tables, change logs, ingestion and streaming."""

import random

import pytest
from pyspark.sql import functions as F

from deltaweave.operators.zframe import ZFrame
from deltaweave.plans.circuit import Circuit, Collected
from deltaweave.plans.sqlviews import SqlViews, parse_columns, split_statements
from deltaweave.sources.keyed import KeyedTable, change_batch, current_rows, log_to_weights
from deltaweave.streaming.runtime import MaintainedViews, drop_stale, first_by_id, freshness, in_batches, interval_join, keep_newest, keep_oldest


def z(spark, rows, schema):
    return ZFrame.from_entries(spark, rows, schema)


def rows(frame):
    return sorted(tuple(r) for r in frame.bag().collect())


def test_statements_split_outside_quotes():
    assert split_statements("SELECT ';' ; -- a;b\nSELECT `x;y` /* ; */;;") == ["SELECT ';'", "-- a;b\nSELECT `x;y` /* ; */"]


def test_ddl_types():
    assert parse_columns("id BIGINT PRIMARY KEY, s VARCHAR(10), d DECIMAL(10,2), PRIMARY KEY (id), b BOOL") == "`id` BIGINT, `s` STRING, `d` DECIMAL(10,2), `b` BOOLEAN"


ORDERS = "id long, customer_id long, amount double, status string"


def views(spark, select, more=""):
    return SqlViews(spark, f"CREATE TABLE orders (id BIGINT, customer_id BIGINT, amount DOUBLE, status VARCHAR); CREATE TABLE customers (cid BIGINT, name VARCHAR); CREATE VIEW v AS {select}; {more}")


@pytest.mark.parametrize(
    ("select", "strategy"),
    [
        ("SELECT id, amount * 2 AS twice FROM orders WHERE status = 'a;b' OR amount > 5", "linear"),
        ("SELECT id FROM orders UNION ALL SELECT cid FROM customers", "linear"),
        ("SELECT id FROM orders WHERE customer_id IN (SELECT cid FROM customers)", "recompute"),
        ("SELECT a.id FROM orders a, orders b WHERE a.id = b.id", "recompute"),
        ("SELECT o.id, name FROM orders o JOIN customers c ON o.customer_id = c.cid AND o.amount > 3", "joined"),
        ("SELECT id, name FROM orders, customers WHERE customer_id = cid", "joined"),
        ("SELECT id, name FROM orders LEFT JOIN customers ON customer_id = cid WHERE amount > 1", "outer"),
        ("SELECT id FROM orders LEFT ANTI JOIN customers ON customer_id = cid", "outer"),
        ("SELECT id, name FROM orders LEFT JOIN customers ON customer_id < cid", "recompute"),
        ("SELECT count(*) AS n, sum(amount) + 1 AS s FROM orders WHERE status <> 'GROUP BY'", "grouped"),
        ("SELECT c.name, sum(o.amount) / count(*) AS s FROM orders o JOIN customers c ON o.customer_id = c.cid GROUP BY c.name", "grouped"),
        ("SELECT upper(status) AS u, max(amount) AS hi FROM orders GROUP BY upper(status)", "grouped"),
        ("SELECT max(amount) AS hi FROM orders", "recompute"),
        ("SELECT status, count(DISTINCT customer_id) AS n FROM orders GROUP BY status", "recompute"),
        ("SELECT status, count(*) AS n FROM orders GROUP BY status ORDER BY n", "recompute"),
        ("SELECT status, amount + 1 AS a, count(*) AS n FROM orders GROUP BY status, amount", "grouped"),
        ("SELECT DISTINCT status FROM orders", "recompute"),
        ("SELECT id, rand() AS r FROM orders", "recompute"),
        ("SELECT status, count(*) AS n FROM orders GROUP BY status HAVING count(*) > 1", "grouped"),
        ("SELECT id FROM orders ORDER BY amount DESC LIMIT 1", "recompute"),
        ("SELECT id FROM orders UNION ALL SELECT id FROM orders", "recompute"),
    ],
)
def test_strategies(spark, select, strategy):
    assert views(spark, select).views["v"].strategy == strategy


def test_having_order_limit_case_and_union_run(spark):
    v = views(
        spark,
        "SELECT status, count(*) AS n, avg(amount) AS mean, CASE WHEN max(amount) > 20 THEN 'hi' ELSE 'lo' END AS band FROM orders GROUP BY status HAVING count(*) > 1",
        "CREATE VIEW top AS SELECT id FROM orders ORDER BY amount DESC, id LIMIT 1; CREATE VIEW named AS SELECT o.id, c.name FROM orders o LEFT JOIN customers AS c ON o.customer_id = c.cid; CREATE VIEW many AS SELECT id FROM orders UNION SELECT cid FROM customers UNION SELECT 99 AS x",
    )
    v.step({"orders": z(spark, [((1, 7, 10.0, "p"), 1), ((2, 8, 30.0, "p"), 1), ((3, 7, 5.0, "q"), 1)], ORDERS), "customers": z(spark, [((7, "Ann"), 1)], "cid long, name string")})
    assert rows(v.table("v")) == [("p", 2, 20.0, "hi")] and rows(v.table("top")) == [(2,)]
    assert rows(v.table("named")) == [(1, "Ann"), (2, None), (3, "Ann")]
    delta = v.step({"orders": z(spark, [((2, 8, 30.0, "p"), -1)], ORDERS)})
    assert rows(v.table("v")) == [] and rows(v.table("top")) == [(1,)]
    assert {(r.id, r.weight) for r in delta["named"].entries().collect()} == {(2, -1)}
    assert rows(v.table("many")) == [(1,), (3,), (7,), (99,)]


SELECTS = {
    "joined": "SELECT o.id, c.name, o.amount FROM orders o JOIN customers c ON o.customer_id = c.cid WHERE o.status <> 'q' OR c.name = 'n1'",
    "grouped": "SELECT status, count(*) AS n, count(amount) AS k, sum(amount) AS s, sum(id) AS t, avg(customer_id) AS m FROM orders GROUP BY status HAVING count(*) > 1 AND status <> ''",
    "extremes": "SELECT customer_id % 2 AS parity, min(amount) AS lo, max(id) AS hi, count(*) AS n FROM orders GROUP BY customer_id % 2",
    "both": "SELECT name, count(*) AS n, sum(id) AS s FROM orders, customers WHERE customer_id = cid GROUP BY 1",
    "whole": "SELECT count(*) AS n, sum(id) AS s, avg(id) AS m, CASE WHEN count(amount) > 3 THEN 'many' ELSE 'few' END AS band FROM orders",
    "outer": "SELECT id, name, cid FROM orders FULL JOIN customers ON customer_id = cid",
    "anti": "SELECT id FROM orders LEFT ANTI JOIN customers ON customer_id = cid",
    "distinct": "SELECT DISTINCT status, customer_id FROM orders",
}


def test_views_equal_their_batch_over_random_steps(spark):
    """Random changes with nulls, copies and retractions; every view against its text."""
    rng = random.Random(12)
    script = "; ".join(f"CREATE VIEW {n} AS {t}" for n, t in SELECTS.items())
    v = SqlViews(spark, f"CREATE TABLE orders (id BIGINT, customer_id BIGINT, amount DOUBLE, status VARCHAR); CREATE TABLE customers (cid BIGINT, name VARCHAR); {script}; CREATE VIEW upper_names AS SELECT upper(name) AS u, n FROM both")
    assert {n: v.views[n].strategy for n in SELECTS} == {"joined": "joined", "grouped": "grouped", "extremes": "grouped", "both": "grouped", "whole": "grouped", "outer": "outer", "anti": "outer", "distinct": "recompute"}
    held = {"orders": [], "customers": []}
    schemas = {"orders": ORDERS, "customers": "cid long, name string"}
    for step in range(5):
        deltas = {}
        for name, make in (("orders", lambda: (rng.randint(0, 9), rng.choice([None, 1, 2, 3]), rng.choice([None, 0.1, 0.2, 0.7, 5.0]), rng.choice([None, "p", "q", "r"]))), ("customers", lambda: (rng.choice([None, 1, 2, 3]), rng.choice(["n1", "n2", None])))):
            change = [(row, -1) for row in rng.sample(held[name], len(held[name]) // 3)] + [(make(), 1) for _ in range(rng.randint(0, 6))]
            for row, w in change:
                held[name].append(row) if w > 0 else held[name].remove(row)
            if change and not (step == 2 and name == "customers"):
                deltas[name] = z(spark, change, schemas[name])
            else:
                for row, w in change:
                    held[name].remove(row) if w > 0 else held[name].append(row)
        v.step(deltas)
    for name, rows_ in held.items():
        spark.createDataFrame(rows_, schemas[name]).createOrReplaceTempView(f"t_{name}")
    def plain(found):
        return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in found)
    for name, text in SELECTS.items():
        want = spark.sql(text.replace("orders", "t_orders").replace("customers", "t_customers"))
        assert plain(v.table(name).bag().collect()) == plain(want.collect()), name
        assert v.table(name).consolidate().df.where("__w < 0").isEmpty()
        assert [f.dataType for f in v.schemas[name].fields] == [f.dataType for f in want.schema.fields]
    assert v.table("upper_names").bag().count() == v.table("both").bag().count()


def test_views_read_views_and_nulls_are_three_valued(spark):
    v = views(spark, "SELECT id, status FROM orders WHERE NOT (status = 'x')", "CREATE VIEW w AS SELECT count(*) AS n, count(status) AS k FROM v")
    v.step({"orders": z(spark, [((1, 1, 1.0, None), 1), ((2, 1, 1.0, "y"), 1)], ORDERS)})
    assert rows(v.table("w")) == [(1, 1)]


def test_average_is_incremental(spark):
    v = SqlViews(spark, "CREATE TABLE nums (id INT, num INT); CREATE VIEW a AS SELECT avg(num) AS m FROM nums")
    v.step({"nums": z(spark, [((i, 10 * i), 1) for i in (1, 2, 3)], "id int, num int")})
    assert rows(v.table("a")) == [(20.0,)]
    v.step({"nums": z(spark, [((4, 40), 1)], "id int, num int")})
    assert rows(v.table("a")) == [(25.0,)]


def test_other_statements_are_errors(spark):
    with pytest.raises(ValueError, match="only"):
        SqlViews(spark, "DROP TABLE t")


KEYED = "id long, v string"


def frame(spark, data, schema=KEYED):
    return spark.createDataFrame(data, schema)


def test_keyed_verbs(spark):
    t, sink = KeyedTable(spark, KEYED, "id"), Collected()
    sink(t.push(frame(spark, [(1, "a"), (2, "b")])))
    delta = t.push(frame(spark, [(2, "B"), (3, "c")]))
    assert {tuple(r) for r in delta.entries().collect()} == {(2, "b", -1), (2, "B", 1), (3, "c", 1)}
    sink(delta)
    with pytest.raises(KeyError):
        t.insert(frame(spark, [(1, "x")]))
    sink(t.insert_many(frame(spark, [(1, "x"), (4, "d")])))
    sink(t.update("id = 1", v=F.lit("A")))
    sink(t.remove(frame(spark, [(3, None), (9, None)])))
    sink(t.remove_where("v = 'd'"))
    assert t.exists("id = 1") and t.get("id = 1").v == "A" and not t.exists("id = 3")
    assert sorted(map(tuple, t.rows.collect())) == rows(sink.table) == [(1, "A"), (2, "B")]
    assert t.set_data(frame(spark, [(1, "A"), (5, "e")])).size() == 2
    t.clear()
    assert t.stats()["rows"] == 0


def test_self_cancelling_log_is_empty(spark):
    log = spark.createDataFrame([(1, "a", "insert", 1), (1, "a", "delete", 2), (2, "b", "insert", 3), (2, "c", "update", 4)], "id long, v string, op string, seq long")
    t = KeyedTable(spark, KEYED, "id")
    assert {tuple(r) for r in t.apply(log).entries().collect()} == {(2, "c", 1)}
    assert log_to_weights(log, "id", "op", "seq").equals(ZFrame.of(current_rows(log, "id", "op", "seq")))


def test_change_batch_shares(spark):
    table = spark.range(10_000).selectExpr("id", "cast(id AS string) AS v")
    delta = change_batch(table, "id", 0.1, {"v": F.lit("new")})
    w = {r["__w"]: r["count"] for r in delta.df.groupBy("__w").count().collect()}
    assert 700 < w[1] < 900 and 500 < w[-1] < 700


def test_composite_keys_do_not_collide(spark):
    t = KeyedTable(spark, "a string, b string, v long", ["a", "b"])
    t.push(spark.createDataFrame([("x::y", "z", 1), ("x", "y::z", 2), (None, "z", 3)], "a string, b string, v long"))
    assert t.rows.count() == 3


MESSAGES = "id string, seq long, ts timestamp, amount long"


def test_ingest_filters(spark):
    m = spark.sql(f"SELECT * FROM VALUES ('m1', 1L, TIMESTAMP '2024-01-01 00:00:00', 100L), ('m1', 2L, TIMESTAMP '2024-01-01 00:00:05', 200L), (NULL, 3L, TIMESTAMP '2024-01-01 00:00:09', 1L), (NULL, 4L, TIMESTAMP '2024-01-01 00:00:10', 2L) AS t({', '.join(c.split()[0] for c in MESSAGES.split(', '))})")
    assert sorted(r.amount for r in first_by_id(m, "id", "seq").collect()) == [1, 2, 100]
    assert [r.seq for r in keep_newest(m, "seq", 2).orderBy("seq").collect()] == [3, 4]
    assert [r.seq for r in keep_oldest(m, "seq", 1).collect()] == [1]
    now = F.lit("2024-01-01 00:00:10").cast("timestamp")
    assert drop_stale(m, "ts", "5 SECONDS", now).count() == 3
    assert tuple(freshness(m, "ts", now).first()) == (4, 10.0)
    with pytest.raises(ValueError):
        keep_newest(m, "seq", 0)


def test_micro_batches_maintain_views(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).selectExpr("id", "id % 3 AS g").coalesce(1).write.mode("append").parquet(str(source))
    circuit = Circuit(spark)
    keyed = MaintainedViews(circuit, "n", target=str(tmp_path / "out"))
    numbers = circuit.input("n", "id long, g long")
    keyed.view("counts", numbers.group_sums("g", n=("count", None)))
    keyed.view("big", numbers.filter("id > 25"))
    stream = spark.readStream.schema("id long, g long").option("maxFilesPerTrigger", 1).parquet(str(source))
    in_batches(stream, keyed.process, str(tmp_path / "checkpoint")).awaitTermination()
    assert rows(keyed.current("counts")) == [(0, 10), (1, 10), (2, 10)] and keyed.current("big").size() == 4
    assert circuit.steps == 3
    keyed.process(spark.range(1).selectExpr("id", "id AS g"), 2)  # a batch id that was applied
    assert circuit.steps == 3
    assert spark.read.parquet(str(tmp_path / "out" / "counts" / "batch=2")).count() == 3


def test_stream_join_within_interval(spark, tmp_path):
    for name, offset in (("l", 0), ("r", 30)):
        spark.range(5).selectExpr(f"id AS {name}", f"timestamp_seconds(1700000000 + id * 100 + {offset}) AS {name}_ts").coalesce(1).write.parquet(str(tmp_path / name))
    left, right = (spark.readStream.schema(f"{n} long, {n}_ts timestamp").parquet(str(tmp_path / n)) for n in "lr")
    joined = interval_join(left, right, ("l", "r"), ("l_ts", "r_ts"), "40 SECONDS", "1 hour")
    joined.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5


def test_two_streams_keep_a_join(spark, tmp_path):
    from deltaweave.sources.feeds import change_feed, dump, file_stream, load, snapshot_then_changes
    from deltaweave.streaming.progress import Progress

    dump(frame(spark, [(1, "a"), (2, "b")]), str(tmp_path / "names"))
    dump(spark.createDataFrame([(1, 5), (1, 6), (3, 7)], "k long, n long"), str(tmp_path / "numbers"), "parquet")
    assert load(spark, str(tmp_path / "names"), KEYED).count() == 2
    listener = Progress()
    spark.streams.addListener(listener)
    circuit = Circuit(spark)
    names, numbers = circuit.input("names", KEYED), circuit.input("numbers", "k long, n long")
    kept = MaintainedViews(circuit, "names")
    kept.view("joined", names.join(numbers, "id", "k", select=["v", "n"]))
    first = in_batches(file_stream(spark, str(tmp_path / "names"), KEYED, "json"), kept.process, str(tmp_path / "c1"))
    second = in_batches(file_stream(spark, str(tmp_path / "numbers"), "k long, n long"), kept.feed("numbers"), str(tmp_path / "c2"))
    first.awaitTermination()
    second.awaitTermination()
    assert rows(kept.current("joined")) == [("a", 5), ("a", 6)]
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.streams.removeListener(listener)
    assert listener.stats(first.id)["rows"] == 2 and listener.stats("none")["batches"] == 0
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "1.json").write_text('{"op":"update","seq":9,"row":{"id":2,"v":"B"}}\n{"op":"delete","seq":10,"row":{"id":1}}\n')
    got = []
    in_batches(change_feed(spark, str(tmp_path / "feed"), KEYED), lambda b, _: got.extend(b.collect()), str(tmp_path / "c3")).awaitTermination()
    log = snapshot_then_changes(frame(spark, [(1, "a"), (2, "b")]), spark.createDataFrame(got, "op string, seq long, id long, v string"))
    assert sorted(map(tuple, current_rows(log, "id", "op", "seq").collect())) == [(2, "B")]


def test_observed_counts(spark):
    from deltaweave.operators.joins import observed

    table, seen = observed(z(spark, [((1, "a"), 3), ((2, "b"), -1)], KEYED), "t")
    table.df.collect()
    assert seen.get == {"rows": 2, "weight": 2}
