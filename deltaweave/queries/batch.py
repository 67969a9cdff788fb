"""Whole-table queries: weighted algebra, predicates, joins, aggregates, order, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deltaweave.functions.predicates import all_of, any_of, none_of, numeric_mask, position, ratio, string_mask
from deltaweave.operators import joins
from deltaweave.operators.zframe import W, ZFrame, weighted_avg, weighted_count, weighted_max, weighted_min, weighted_sum
from deltaweave.queries.registry import cents, query, table, total

# -- weighted algebra ------------------------------------------------------------------


@query("zset_consolidate_dups", "SELECT l_returnflag, l_linestatus, count(*) AS weight FROM lineitem GROUP BY 1, 2")
def zset_consolidate_dups(spark, sf):
    return ZFrame.of(table(spark, sf, "lineitem")).map("l_returnflag", "l_linestatus").entries()


@query("zset_add_negate_subtract", "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(1 AS BIGINT) AS weight FROM orders WHERE o_orderstatus <> 'F'")
def zset_add_negate_subtract(spark, sf):
    orders = ZFrame.of(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))
    return orders.subtract(orders.filter("o_orderstatus = 'F'")).entries()


@query("zset_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def zset_distinct(spark, sf):
    return ZFrame.of(table(spark, sf, "orders")).map("o_custkey", "o_orderstatus").distinct().values()


@query(
    "zset_intersect",
    "SELECT l_returnflag, l_shipmonth, CAST(least(a, b) AS BIGINT) AS weight FROM (SELECT l_returnflag, month(l_shipdate) AS l_shipmonth, count(*) FILTER (WHERE l_linenumber <= 2) AS a, count(*) FILTER (WHERE l_quantity > 20) AS b FROM lineitem GROUP BY 1, 2) WHERE least(a, b) > 0",
)
def zset_intersect(spark, sf):
    rows = ZFrame.of(table(spark, sf, "lineitem"))
    shape = (F.col("l_returnflag"), F.month("l_shipdate").cast("long").alias("l_shipmonth"))
    return rows.filter("l_linenumber <= 2").map(*shape).intersect(rows.filter("l_quantity > 20").map(*shape)).entries()


@query("zset_map_collision", "SELECT o_custkey % 7 AS bucket, count(*) AS weight FROM orders GROUP BY 1")
def zset_map_collision(spark, sf):
    return ZFrame.of(table(spark, sf, "orders")).map("o_custkey % 7 AS bucket").entries()


@query("zset_count_sum", "SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders")
def zset_count_sum(spark, sf):
    return ZFrame.of(table(spark, sf, "orders")).reduce(weighted_count().alias("n"), weighted_sum(cents("o_totalprice")).cast("double").alias("total"))


# -- predicates ------------------------------------------------------------------------


@query("filter_eq", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def filter_eq(spark, sf):
    return ZFrame.of(table(spark, sf, "orders")).filter("o_orderstatus = 'P'").map("o_orderkey", "o_orderpriority").bag()


@query("filter_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 100000 AND o_orderstatus <> 'F'")
def filter_range(spark, sf):
    return table(spark, sf, "orders").where("o_totalprice > 1000 AND o_totalprice <= 100000 AND o_orderstatus != 'F'").select("o_orderkey", "o_totalprice")


@query("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice < 50000) AND NOT (o_custkey < 100)")
def filter_and_or_not(spark, sf):
    mask = all_of(any_of(string_mask("o_orderstatus", "=", "F"), numeric_mask("o_totalprice", "<", 50000)), none_of(numeric_mask("o_custkey", "<", 100)))
    return table(spark, sf, "orders").where(mask).select("o_orderkey")


@query("filter_between_in", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#23', 'Brand#45')")
def filter_between_in(spark, sf):
    return table(spark, sf, "part").where(numeric_mask("p_size", "between", 10, 20) & string_mask("p_brand", "in", ["Brand#11", "Brand#23", "Brand#45"])).select("p_partkey", "p_size")


_NULLED = "(SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders)"


@query("filter_null", f"SELECT o_orderkey, CASE WHEN s IS NULL THEN 'none' ELSE s END AS s, s IS NOT NULL AS known FROM {_NULLED} WHERE s IS NULL OR s IS NOT NULL AND s <> 'F'")
def filter_null(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("s"))
    return rows.where("s IS NULL OR s IS NOT NULL AND s <> 'F'").select("o_orderkey", F.coalesce("s", F.lit("none")).alias("s"), F.col("s").isNotNull().alias("known"))


@query("filter_three_valued", f"SELECT count(*) AS n, count(s) AS n_known, count(*) FILTER (WHERE s = 'F' OR NOT (s = 'F')) AS n_decided FROM {_NULLED}")
def filter_three_valued(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("s"))
    return rows.agg(F.count("*").alias("n"), F.count("s").alias("n_known"), F.count_if((F.col("s") == "F") | ~(F.col("s") == "F")).alias("n_decided"))


@query("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e_' OR p_name LIKE 'b%'")
def filter_like(spark, sf):
    return table(spark, sf, "part").where(string_mask("p_name", "like", "%a%e_") | string_mask("p_name", "like", "b%")).select("p_partkey", "p_name")


@query("filter_ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%uil%' OR c_name ILIKE 'CUSTOMER%9'")
def filter_ilike(spark, sf):
    return table(spark, sf, "customer").where(string_mask("c_mktsegment", "like", "%UIL%", ignore_case=True) | string_mask("c_name", "like", "customer%9", ignore_case=True)).select("c_custkey")


@query("filter_not_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT LIKE 'P%' AND o_totalprice NOT BETWEEN 10000 AND 200000")
def filter_not_in(spark, sf):
    return table(spark, sf, "orders").where("o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT LIKE 'P%' AND o_totalprice NOT BETWEEN 10000 AND 200000").select("o_orderkey")


@query("filter_columns", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount < l_tax")
def filter_columns(spark, sf):
    return table(spark, sf, "lineitem").where("l_discount < l_tax").select("l_orderkey", "l_linenumber", "l_partkey")


# -- projection ------------------------------------------------------------------------


@query("project_alias_expr", "SELECT l_orderkey AS order_id, l_partkey AS part_id, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem")
def project_alias_expr(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"), (cents("l_extendedprice") * (1 - cents("l_discount"))).cast("double").alias("revenue"))


@query("flatmap_explode", "SELECT word, count(*) AS weight FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def flatmap_explode(spark, sf):
    return ZFrame.of(table(spark, sf, "part")).flat_map(F.split("p_name", " "), "word").entries()


@query("flatmap_vector", "SELECT label, i AS place, count(*) AS weight FROM (SELECT label, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) WHERE x > 0 GROUP BY 1, 2")
def flatmap_vector(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).where("x > 0")
    return ZFrame.of(rows.select("label", (F.col("i") + 1).cast("long").alias("place"))).entries()


@query("mask_numeric", "SELECT count(*) FILTER (WHERE p_size = 7) AS eq, count(*) FILTER (WHERE p_size <> 7) AS ne, count(*) FILTER (WHERE p_size >= 30) AS ge, count(*) FILTER (WHERE p_size BETWEEN 5 AND 9) AS bt FROM part")
def mask_numeric(spark, sf):
    return table(spark, sf, "part").agg(*(F.count_if(numeric_mask("p_size", op, a, b)).alias(n) for n, op, a, b in (("eq", "=", 7, None), ("ne", "!=", 7, None), ("ge", ">=", 30, None), ("bt", "between", 5, 9))))


@query("mask_string", "SELECT count(*) FILTER (WHERE p_brand = 'Brand#12') AS eq, count(*) FILTER (WHERE p_brand IN ('Brand#12', 'Brand#34')) AS isin, count(*) FILTER (WHERE p_type LIKE '%A%') AS contains, count(*) FILTER (WHERE p_name LIKE 'a%b%') AS inner_part FROM part")
def mask_string(spark, sf):
    return table(spark, sf, "part").agg(
        F.count_if(string_mask("p_brand", "=", "Brand#12")).alias("eq"),
        F.count_if(string_mask("p_brand", "in", ["Brand#12", "Brand#34"])).alias("isin"),
        F.count_if(string_mask("p_type", "like", "%A%")).alias("contains"),
        F.count_if(string_mask("p_name", "like", "a%b%")).alias("inner_part"),
    )


@query("masked_sum_avg", "SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS masked_sum, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(*) FILTER (WHERE o_orderstatus = 'F') AS masked_avg FROM orders")
def masked_sum_avg(spark, sf):
    rows = ZFrame.of(table(spark, sf, "orders")).filter(string_mask("o_orderstatus", "=", "F"))
    return rows.reduce(weighted_sum(cents("o_totalprice")).cast("double").alias("masked_sum"), weighted_avg(cents("o_totalprice")).alias("masked_avg"))


# -- aggregates ------------------------------------------------------------------------


@query("global_multi_agg", "SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM orders")
def global_multi_agg(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n"), total("o_totalprice").alias("s"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), (total("o_totalprice") / F.count("*")).alias("mean"))


@query("group_multi_agg", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, min(l_discount) AS lo, max(l_tax) AS hi, count(*) AS n FROM lineitem GROUP BY 1, 2")
def group_multi_agg(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(total("l_quantity").alias("sum_qty"), F.min("l_discount").alias("lo"), F.max("l_tax").alias("hi"), F.count("*").alias("n"))


@query("group_expr_agg", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS weighted, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS net FROM lineitem GROUP BY 1")
def group_expr_agg(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum(cents("l_extendedprice") * cents("l_quantity")).cast("double").alias("weighted"), F.sum(cents("l_extendedprice") - cents("l_tax")).cast("double").alias("net"))


@query("having", "SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10 AND sum(CAST(o_totalprice AS DECIMAL(18,2))) > 1000")
def having(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(total("o_totalprice").alias("spent"), F.count("*").alias("n")).where("n > 10 AND spent > 1000")


@query("count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def count_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"))


@query("rollup_levels", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_levels(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("cube_levels", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_levels(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


_SIGNED = "(SELECT *, CASE WHEN l_linenumber = 1 THEN 2 WHEN l_quantity < 10 THEN -1 ELSE 1 END AS w FROM lineitem)"


def _signed(spark, sf):
    rows = table(spark, sf, "lineitem")
    return ZFrame.of(rows, F.when(F.col("l_linenumber") == 1, 2).when(F.col("l_quantity") < 10, -1).otherwise(1))


@query("weighted_min_max", f"SELECT l_returnflag, CAST(sum(w) AS BIGINT) AS n, min(l_extendedprice) FILTER (WHERE w > 0) AS lo, max(l_extendedprice) FILTER (WHERE w > 0) AS hi FROM {_SIGNED} GROUP BY 1")
def weighted_min_max(spark, sf):
    return _signed(spark, sf).df.groupBy("l_returnflag").agg(weighted_count().alias("n"), weighted_min("l_extendedprice").alias("lo"), weighted_max("l_extendedprice").alias("hi"))


@query("weighted_average", f"SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * w) AS DOUBLE) AS s, CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * w) AS DOUBLE) / CAST(sum(w) AS BIGINT) AS mean FROM {_SIGNED} GROUP BY 1")
def weighted_average(spark, sf):
    return _signed(spark, sf).df.groupBy("l_returnflag").agg(weighted_sum(cents("l_quantity")).cast("double").alias("s"), weighted_avg(cents("l_quantity")).alias("mean"))


# -- joins -----------------------------------------------------------------------------


@query("join_weighted_revenue", "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_weighted_revenue(spark, sf):
    orders = ZFrame.of(table(spark, sf, "orders").select("o_custkey", "o_totalprice"))
    customers = ZFrame.of(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))
    joined = joins.join(orders, customers, "o_custkey", "c_custkey")
    return joined.df.groupBy("c_mktsegment").agg(weighted_count().alias("n"), weighted_sum(cents("o_totalprice")).cast("double").alias("revenue"))


def _docs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("l_doc_id"), "quality")
    return ZFrame.of(docs), ZFrame.of(labels)


_LABELS = "(SELECT doc_id AS l_doc_id, quality FROM labels)"


@query("join_inner", f"SELECT doc_id, lang, quality FROM documents JOIN {_LABELS} ON doc_id = l_doc_id")
def join_inner(spark, sf):
    return joins.join(*_docs(spark, sf), "doc_id", "l_doc_id").map("doc_id", "lang", "quality").bag()


def _outer(how):
    def run(spark, sf):
        docs, labels = _docs(spark, sf)
        # documents without a label are the left side's lone rows, and in the right join the right side's
        sides = (labels, docs, "l_doc_id", "doc_id") if how == "right" else (docs, labels, "doc_id", "l_doc_id")
        return joins.outer_join(*sides, how).map("doc_id", "lang", "l_doc_id", "quality").bag()

    return run


for _how, _sides in (("left", f"documents LEFT JOIN {_LABELS}"), ("right", f"{_LABELS} RIGHT JOIN documents"), ("full", f"documents FULL JOIN {_LABELS}")):
    query(f"join_{_how}", f"SELECT doc_id, lang, l_doc_id, quality FROM {_sides} ON doc_id = l_doc_id")(_outer(_how))


@query("join_cross", "SELECT r_name, c_mktsegment, count(*) AS weight FROM region CROSS JOIN customer GROUP BY 1, 2")
def join_cross(spark, sf):
    segments = ZFrame.of(table(spark, sf, "customer")).map("c_mktsegment").consolidate()
    return joins.cartesian(segments, ZFrame.of(table(spark, sf, "region").select("r_name"))).map("r_name", "c_mktsegment").entries()


@query("join_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def join_semi(spark, sf):
    return joins.semi_join(*_docs(spark, sf), "doc_id", "l_doc_id").bag()


@query("join_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, sf):
    return joins.anti_join(ZFrame.of(table(spark, sf, "orders").select("o_orderkey")), ZFrame.of(table(spark, sf, "lineitem").select("l_orderkey")), "o_orderkey", "l_orderkey").bag()


@query("join_filter", "SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_extendedprice * 4 > o_totalprice AND o_orderstatus = 'O'")
def join_filter(spark, sf):
    orders = ZFrame.of(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"))
    lines = ZFrame.of(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"))
    return joins.join(orders, lines, "o_orderkey", "l_orderkey", "l_extendedprice * 4 > o_totalprice AND o_orderstatus = 'O'").map("o_orderkey", "l_partkey", "l_quantity").bag()


@query("join_filter_map", "SELECT c_name, o_orderkey, o_totalprice > 100000 AS large FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
def join_filter_map(spark, sf):
    orders = ZFrame.of(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    customers = ZFrame.of(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"))
    return joins.join(orders, customers, "o_custkey", "c_custkey", "c_acctbal < 0", ["c_name", "o_orderkey", "o_totalprice > 100000 AS large"]).bag()


@query("join_null_keys", "SELECT CAST(sum(n * n) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_orderstatus)")
def join_null_keys(spark, sf):
    """All orders with all orders; the SQL need not make the pairs."""
    return _status_pairs(table(spark, sf, "orders"), table(spark, sf, "orders"))


def _status_pairs(left, right):
    status = F.nullif(F.col("o_orderstatus"), F.lit("O"))
    a, b = (ZFrame.of(orders.select(status.alias(n))).consolidate() for orders, n in ((left, "a"), (right, "b")))
    return joins.join(a, b, "a", "b").reduce(weighted_count().alias("n"))


@query("join_two_keys", "SELECT count(*) AS n, CAST(sum(a.l_linenumber) AS BIGINT) AS s FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE b.l_linenumber = 1")
def join_two_keys(spark, sf):
    lines = table(spark, sf, "lineitem")
    a = ZFrame.of(lines.select("l_partkey", "l_suppkey", "l_linenumber"))
    b = ZFrame.of(lines.where("l_linenumber = 1").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")))
    return joins.join(a, b, ["l_partkey", "l_suppkey"], ["p", "s"]).reduce(weighted_count().alias("n"), weighted_sum("l_linenumber").alias("s"))


@query("join_count_only", "SELECT count(*) AS pairs FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_count_only(spark, sf):
    return joins.match_counts(ZFrame.of(table(spark, sf, "orders")), ZFrame.of(table(spark, sf, "lineitem")), "o_orderkey", "l_orderkey")


_CLICKS = "(SELECT user_id, ts AS click_ts, event_id AS click_id, value FROM events WHERE event_type = 'click')"


def _clicks(spark, sf):
    events = table(spark, sf, "events")
    return events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), events.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"), "value")


@query("asof_backward", f"SELECT p.event_id, p.user_id, c.click_id, c.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN {_CLICKS} c ON p.user_id = c.user_id AND p.ts >= c.click_ts")
def asof_backward(spark, sf):
    purchases, clicks = _clicks(spark, sf)
    return joins.asof_join(purchases, clicks, ["user_id"], "ts", "click_ts", ["click_id", "value"]).select("event_id", "user_id", "click_id", "value")


@query("asof_forward", f"SELECT p.event_id, p.user_id, c.click_id, c.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN {_CLICKS} c ON p.user_id = c.user_id AND p.ts <= c.click_ts")
def asof_forward(spark, sf):
    purchases, clicks = _clicks(spark, sf)
    return joins.asof_join(purchases, clicks, ["user_id"], "ts", "click_ts", ["click_id", "value"], forward=True).select("event_id", "user_id", "click_id", "value")


@query(
    "pruned_join",
    f"WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS {_CLICKS} SELECT p.event_id, c.click_id FROM p JOIN c ON p.user_id = c.user_id WHERE p.ts >= (SELECT max(click_ts) FROM c) - INTERVAL 3 DAY AND c.click_ts >= (SELECT max(ts) FROM p) - INTERVAL 3 DAY",
)
def pruned_join(spark, sf):
    purchases, clicks = _clicks(spark, sf)
    return joins.pruned_join(purchases, clicks.withColumnRenamed("user_id", "click_user"), "user_id", "click_user", "ts", "click_ts", "3 DAYS").select("event_id", "click_id")


# -- set operations, order, scalars ----------------------------------------------------


@query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation")
def union_all(spark, sf):
    parts = [ZFrame.of(table(spark, sf, t).select(F.col(c).alias("k"))) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return parts[0].add(parts[1]).add(parts[2]).bag()


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf):
    a, b = (ZFrame.of(table(spark, sf, t).select(F.col(c).alias("k"))) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return a.add(b).distinct().values()


@query("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark, sf):
    a, b = (ZFrame.of(table(spark, sf, t).select(F.col(c).alias("k"))) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return a.intersect(b).bag()


@query("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark, sf):
    a, b = (ZFrame.of(table(spark, sf, t).select(F.col(c).alias("k"))) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return a.subtract(b).bag()


@query("sort_limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_limit_topk(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("topk_per_group", "SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topk_per_group(spark, sf):
    rank = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf, "orders").withColumn("r", rank).where("r <= 3").select("o_orderstatus", "o_orderkey")


_PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("custom_order", f"SELECT o_orderpriority, CAST(list_position({_PRIORITIES}, o_orderpriority) AS BIGINT) AS place, count(*) AS n FROM orders GROUP BY 1, 2".replace("[", "['").replace("[''", "['"))
def custom_order(spark, sf):
    place = position(F.col("o_orderpriority"), _PRIORITIES).alias("place")
    return table(spark, sf, "orders").groupBy("o_orderpriority", place).agg(F.count("*").alias("n")).orderBy("place")


@query("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def case_when(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low").alias("band"))


@query("coalesce_nullif", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), nullif(o_orderpriority, '5-LOW'), 'none') AS v FROM orders")
def coalesce_nullif(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("O")), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit("none")).alias("v"))


@query("cast_types", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_custkey AS INTEGER) AS i, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, o_orderstatus = 'F' AS f FROM orders")
def cast_types(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("s"), F.col("o_custkey").cast("int").alias("i"), F.col("o_orderdate").cast("date").cast("string").alias("d"), (F.col("o_orderstatus") == "F").alias("f"))


@query("string_funcs", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, substring(p_type, 2, 3) AS s, length(p_name) AS n, concat(p_brand, '-', p_type) AS c, trim(replace(p_name, 'a', ' ')) AS t FROM part")
def string_funcs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_brand").alias("l"), F.substring("p_type", 2, 3).alias("s"), F.length("p_name").cast("long").alias("n"), F.concat("p_brand", F.lit("-"), "p_type").alias("c"), F.trim(F.replace(F.col("p_name"), F.lit("a"), F.lit(" "))).alias("t"))


@query("arith_div_zero", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / nullif(l_linenumber - 1, 0) AS q, coalesce(l_quantity / nullif(l_linenumber - 1, 0), 0) AS q0, l_orderkey % 7 AS m FROM lineitem")
def arith_div_zero(spark, sf):
    below = F.col("l_linenumber") - 1
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ratio(F.col("l_quantity"), below).alias("q"), ratio(F.col("l_quantity"), below, 0.0).alias("q0"), (F.col("l_orderkey") % 7).alias("m"))


@query("window_share", "SELECT c_mktsegment, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS BIGINT) AS share FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def window_share(spark, sf):
    # one row a segment: the window over all of them is small
    counts = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return counts.select("c_mktsegment", (F.col("n").cast("double") / F.sum("n").over(Window.partitionBy())).alias("share"))


@query("reduce_udaf", "SELECT o_orderstatus, CAST(bit_xor(o_orderkey) AS BIGINT) AS x FROM orders GROUP BY 1")
def reduce_udaf(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.bit_xor("o_orderkey").alias("x"))


@query("zset_signs", "SELECT count(*) FILTER (WHERE w > 0) AS positive, count(*) FILTER (WHERE w < 0) AS negative FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') - count(*) FILTER (WHERE o_orderstatus = 'O') AS w FROM orders GROUP BY 1) WHERE w <> 0")
def zset_signs(spark, sf):
    orders = ZFrame.of(table(spark, sf, "orders"))
    diff = orders.filter("o_orderstatus = 'F'").map("o_custkey").subtract(orders.filter("o_orderstatus = 'O'").map("o_custkey")).consolidate()
    return diff.reduce(F.count_if(F.col(W) > 0).alias("positive"), F.count_if(F.col(W) < 0).alias("negative"))
