"""Application queries: dashboards of an order book and of a credit desk, on stand-in tables.

Orders, customers (segment as tier) and parts play the shop; lines play requests and positions
(supplier: counterparty; part type: sector; the supplier's nation: desk; return flag R: filled;
line status O: bid or long; price: notional; quantity: dv01; tax times price: profit); events
play signals (type: model; user: issuer; value over 50: long; value / 100: confidence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.functions.predicates import position, ratio
from deltaweave.operators import joins
from deltaweave.operators.zframe import ZFrame
from deltaweave.queries.registry import cents, query, table, total

_D = "DECIMAL(18,2)"


def _sum(column: str) -> str:
    return f"CAST(sum(CAST({column} AS {_D})) AS DOUBLE)"


# -- the shop --------------------------------------------------------------------------


@query("shop_pending_large", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 300000")
def shop_pending_large(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'P' OR o_totalprice > 300000").select("o_orderkey", "o_custkey", "o_totalprice")


def _located(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer's region."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "r_name")
    return table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))


@query("shop_by_region", f"SELECT r_name, {_sum('o_totalprice')} AS s, count(*) AS n, {_sum('o_totalprice')} / count(*) AS mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def shop_by_region(spark, sf):
    return _located(spark, sf).groupBy("r_name").agg(total("o_totalprice").alias("s"), F.count("*").alias("n"), (total("o_totalprice") / F.count("*")).alias("mean"))


@query("shop_by_status", f"SELECT o_orderstatus, {_sum('o_totalprice')} AS s, count(*) AS n FROM orders GROUP BY 1")
def shop_by_status(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(total("o_totalprice").alias("s"), F.count("*").alias("n"))


@query("shop_by_category", f"SELECT p_type, {_sum('l_extendedprice')} AS s, count(*) AS n, {_sum('l_quantity')} AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def shop_by_category(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("p_type").agg(total("l_extendedprice").alias("s"), F.count("*").alias("n"), total("l_quantity").alias("quantity"))


@query("shop_weighted_average", f"SELECT p_type, CAST(sum(CAST(l_extendedprice AS {_D}) * CAST(l_quantity AS {_D})) AS DOUBLE) / {_sum('l_quantity')} AS mean FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def shop_weighted_average(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("p_type").agg((F.sum(cents("l_extendedprice") * cents("l_quantity")).cast("double") / total("l_quantity")).alias("mean"))


@query("shop_top_customers", f"SELECT o_custkey, {_sum('o_totalprice')} AS spent, count(*) AS n FROM orders GROUP BY 1 HAVING sum(CAST(o_totalprice AS {_D})) > 1000 ORDER BY 2 DESC, 1 LIMIT 10")
def shop_top_customers(spark, sf):
    spent = table(spark, sf, "orders").groupBy("o_custkey").agg(total("o_totalprice").alias("spent"), F.count("*").alias("n"))
    return spent.where("spent > 1000").orderBy(F.desc("spent"), "o_custkey").limit(10)


_TIERS = ["MACHINERY", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE", "BUILDING"]


@query("shop_tier_revenue", f"SELECT c_mktsegment, {_sum('o_totalprice')} AS revenue, count(*) AS n, CAST(coalesce(list_position({_TIERS!r}, c_mktsegment), 0) AS BIGINT) AS place FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def shop_tier_revenue(spark, sf):
    tiers = _located(spark, sf).groupBy("c_mktsegment").agg(total("o_totalprice").alias("revenue"), F.count("*").alias("n"))
    return tiers.withColumn("place", position(F.col("c_mktsegment"), _TIERS)).orderBy("place")


@query("shop_valid_orphans", "SELECT count(*) FILTER (WHERE known) AS valid, count(*) FILTER (WHERE NOT known) AS orphans FROM (SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem) AS known FROM orders)")
def shop_valid_orphans(spark, sf):
    orders = ZFrame.of(table(spark, sf, "orders").select("o_orderkey"))
    lines = ZFrame.of(table(spark, sf, "lineitem").select("l_orderkey"))
    valid, orphans = (kind(orders, lines, "o_orderkey", "l_orderkey").count() for kind in (joins.semi_join, joins.anti_join))
    both = valid.select(F.lit("valid").alias("kind"), "count").unionByName(orphans.select(F.lit("orphans").alias("kind"), "count"))
    return both.agg(*(F.max(F.when(F.col("kind") == k, F.col("count"))).alias(k) for k in ("valid", "orphans")))


@query("join_selectivity", "SELECT CAST(m AS DOUBLE) / (CAST(l AS DOUBLE) * r) AS selectivity FROM (SELECT count(*) AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey), (SELECT count(*) AS l FROM orders), (SELECT count(*) AS r FROM lineitem)")
def join_selectivity(spark, sf):
    left, right = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    pairs = joins.match_counts(ZFrame.of(left), ZFrame.of(right), "o_orderkey", "l_orderkey")
    parts = [pairs.select(F.lit("m").alias("k"), F.col("pairs").alias("n")), left.agg(F.count("*").alias("n")).select(F.lit("l").alias("k"), "n"), right.agg(F.count("*").alias("n")).select(F.lit("r").alias("k"), "n")]
    one = parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*(F.max(F.when(F.col("k") == k, F.col("n"))).cast("double").alias(k) for k in "mlr"))
    return one.select((F.col("m") / (F.col("l") * F.col("r"))).alias("selectivity"))


# -- the desk --------------------------------------------------------------------------

_POSITIONS = f"(SELECT l_suppkey, p_type AS sector, CAST(s_nationkey AS INTEGER) AS desk, l_returnflag = 'R' AS filled, CAST(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE -l_extendedprice END AS {_D}) AS notional, CAST(l_extendedprice AS {_D}) AS size, CAST(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END AS {_D}) AS dv01, (CAST(l_tax AS {_D}) - 0.03) * CAST(l_extendedprice AS {_D}) AS pnl, CAST(l_discount AS {_D}) AS spread FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"
_SECTORS = f"(SELECT sector, sum(pnl) AS pnl, sum(dv01) AS dv01, sum(notional) AS notional FROM {_POSITIONS} GROUP BY 1)"


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("sector"))
    suppliers = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("desk"))
    lines = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    sign = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    return lines.select(
        "l_suppkey", "sector", "desk", (F.col("l_returnflag") == "R").alias("filled"), cents(sign * F.col("l_extendedprice")).alias("notional"), cents("l_extendedprice").alias("size"),
        cents(sign * F.col("l_quantity")).alias("dv01"), ((cents("l_tax") - F.expr("0.03BD")) * cents("l_extendedprice")).alias("pnl"), cents("l_discount").alias("spread"),
    )


def _sectors(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(spark, sf).groupBy("sector").agg(*(F.sum(c).alias(c) for c in ("pnl", "dv01", "notional")))


@query("desk_rollups", f"SELECT desk, sector, CAST(sum(notional) AS DOUBLE) AS notional, CAST(sum(pnl) AS DOUBLE) AS pnl, count(*) AS n FROM {_POSITIONS} GROUP BY 1, 2")
def desk_rollups(spark, sf):
    return _positions(spark, sf).groupBy("desk", "sector").agg(F.sum("notional").cast("double").alias("notional"), F.sum("pnl").cast("double").alias("pnl"), F.count("*").alias("n"))


@query("desk_totals", f"SELECT CAST(sum(pnl) AS DOUBLE) AS pnl, CAST(sum(abs(dv01)) AS DOUBLE) AS dv01, CAST(sum(abs(notional)) AS DOUBLE) AS notional FROM {_SECTORS}")
def desk_totals(spark, sf):
    return _sectors(spark, sf).agg(F.sum("pnl").cast("double").alias("pnl"), F.sum(F.abs("dv01")).cast("double").alias("dv01"), F.sum(F.abs("notional")).cast("double").alias("notional"))


@query("desk_hit_rate", f"SELECT count(*) AS requests, count(*) FILTER (WHERE filled) AS fills, count(*) FILTER (WHERE filled) / CAST(count(*) AS DOUBLE) AS hit_rate, CAST(sum(spread) FILTER (WHERE filled) AS DOUBLE) / count(*) FILTER (WHERE filled) AS capture FROM {_POSITIONS}")
def desk_hit_rate(spark, sf):
    filled = F.count_if("filled")
    return _positions(spark, sf).agg(F.count("*").alias("requests"), filled.alias("fills"), (filled / F.count("*").cast("double")).alias("hit_rate"), ratio(F.sum(F.when(F.col("filled"), F.col("spread"))).cast("double"), filled).alias("capture"))


@query("desk_counterparties", f"SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE filled) AS fills, count(*) FILTER (WHERE filled) / CAST(count(*) AS DOUBLE) AS hit_rate, CAST(sum(size) AS DOUBLE) AS notional, coalesce(CAST(sum(spread) FILTER (WHERE filled) AS DOUBLE) / nullif(count(*) FILTER (WHERE filled), 0), 0) AS capture FROM {_POSITIONS} GROUP BY 1")
def desk_counterparties(spark, sf):
    filled = F.count_if("filled")
    rates = _positions(spark, sf).groupBy("l_suppkey").agg(
        F.count("*").alias("n"), filled.alias("fills"), (filled / F.count("*").cast("double")).alias("hit_rate"), F.sum("size").cast("double").alias("notional"),
        ratio(F.sum(F.when(F.col("filled"), F.col("spread"))).cast("double"), filled, 0.0).alias("capture"),
    )
    return rates.orderBy(F.desc("notional"), "l_suppkey")


_SIGNALS = f"(SELECT event_type AS model, user_id AS issuer, value > 50 AS long, CAST(value AS {_D}) * 0.01 AS confidence, CAST(value AS {_D}) AS signal FROM events)"


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("issuer"), (F.col("value") > 50).alias("long"), (cents("value") * F.expr("0.01BD")).alias("confidence"), cents("value").alias("signal"))


@query("signal_models", f"SELECT model, count(*) AS n, count(*) FILTER (WHERE confidence > 0.8) AS strong, count(*) FILTER (WHERE long) AS longs, count(*) FILTER (WHERE NOT long) AS shorts, CAST(sum(confidence) AS DOUBLE) / count(*) AS mean_confidence, CAST(sum(signal) AS DOUBLE) / count(*) AS mean_signal FROM {_SIGNALS} GROUP BY 1")
def signal_models(spark, sf):
    return _signals(spark, sf).groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") > 0.8).alias("strong"), F.count_if("long").alias("longs"), F.count_if(~F.col("long")).alias("shorts"),
        (F.sum("confidence").cast("double") / F.count("*")).alias("mean_confidence"), (F.sum("signal").cast("double") / F.count("*")).alias("mean_signal"),
    )


@query("aligned_join", f"SELECT model, count(*) AS n FROM orders JOIN {_SIGNALS} ON o_custkey = issuer WHERE (o_orderstatus = 'O') = long AND confidence > 0.6 GROUP BY 1")
def aligned_join(spark, sf):
    orders = ZFrame.of(table(spark, sf, "orders").select("o_custkey", "o_orderstatus"))
    signals = ZFrame.of(_signals(spark, sf).select("model", "issuer", "long", "confidence"))
    aligned = joins.join(orders, signals, "o_custkey", "issuer", "(o_orderstatus = 'O') = long AND confidence > 0.6", ["model"])
    return aligned.entries("n")


@query("signal_effectiveness", f"SELECT model, CAST(coalesce(sum(p) FILTER (WHERE ok), 0) AS DOUBLE) AS aligned, CAST(coalesce(sum(p) FILTER (WHERE NOT ok), 0) AS DOUBLE) AS misaligned, count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE) AS rate, CAST(sum(confidence) AS DOUBLE) / count(*) AS mean_confidence FROM (SELECT model, confidence, CAST(o_totalprice - 100000 AS {_D}) AS p, (o_orderstatus = 'O') = long AS ok FROM orders JOIN {_SIGNALS} ON o_custkey = issuer) GROUP BY 1")
def signal_effectiveness(spark, sf):
    pairs = table(spark, sf, "orders").join(_signals(spark, sf), F.col("o_custkey") == F.col("issuer"))
    rows = pairs.select("model", "confidence", cents(F.col("o_totalprice") - 100000).alias("p"), ((F.col("o_orderstatus") == "O") == F.col("long")).alias("ok"))
    return rows.groupBy("model").agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("p"))), F.lit(0)).cast("double").alias("aligned"), F.coalesce(F.sum(F.when(~F.col("ok"), F.col("p"))), F.lit(0)).cast("double").alias("misaligned"),
        (F.count_if("ok") / F.count("*").cast("double")).alias("rate"), (F.sum("confidence").cast("double") / F.count("*")).alias("mean_confidence"),
    )


@query("risk_ratio", f"SELECT sector, CAST(pnl AS DOUBLE) AS pnl, CAST(abs(dv01) AS DOUBLE) AS dv01, coalesce(CAST(pnl AS DOUBLE) / nullif(CAST(abs(dv01) AS DOUBLE), 0), 0) AS pnl_per_dv01, coalesce(CAST(pnl AS DOUBLE) / nullif(CAST(abs(notional) AS DOUBLE), 0), 0) * 10000 AS bps FROM {_SECTORS}")
def risk_ratio(spark, sf):
    pnl, dv01, notional = F.col("pnl").cast("double"), F.abs("dv01").cast("double"), F.abs("notional").cast("double")
    return _sectors(spark, sf).select("sector", pnl.alias("pnl"), dv01.alias("dv01"), ratio(pnl, dv01, 0.0).alias("pnl_per_dv01"), (ratio(pnl, notional, 0.0) * 10000).alias("bps"))


@query("execution_quality", f"SELECT CAST(s_nationkey AS INTEGER) AS desk, count(*) AS trades, CAST(sum(abs(CAST(l_extendedprice AS {_D}) - CAST(p_retailprice AS {_D}))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) / count(*) AS slippage, count(*) FILTER (WHERE l_returnflag = 'R') / CAST(count(*) AS DOUBLE) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def execution_quality(spark, sf):
    parts, suppliers = table(spark, sf, "part").select("p_partkey", "p_retailprice"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    filled = F.col("l_returnflag") == "R"
    slip = F.sum(F.when(filled, F.abs(cents("l_extendedprice") - cents("p_retailprice")))).cast("double")
    return lines.groupBy(F.col("s_nationkey").cast("int").alias("desk")).agg(F.count("*").alias("trades"), (slip / F.count("*")).alias("slippage"), (F.count_if(filled) / F.count("*").cast("double")).alias("rate"))


@query("weighted_metric", f"SELECT CAST(sum(spread * size) FILTER (WHERE filled) AS DOUBLE) / CAST(sum(size) FILTER (WHERE filled) AS DOUBLE) AS spread FROM {_POSITIONS}")
def weighted_metric(spark, sf):
    rows = _positions(spark, sf).where("filled")
    return rows.agg(ratio(F.sum(F.col("spread") * F.col("size")).cast("double"), F.sum("size").cast("double")).alias("spread"))


@query("hhi", f"SELECT CAST(sum(w * w) AS DOUBLE) / (CAST(sum(w) AS DOUBLE) * CAST(sum(w) AS DOUBLE)) * 10000 AS hhi FROM (SELECT CAST(round(abs(notional)) AS DECIMAL(18,0)) AS w FROM {_SECTORS})")
def hhi(spark, sf):
    w = _sectors(spark, sf).select(F.round(F.abs("notional")).cast("decimal(18,0)").alias("w"))
    return w.agg((F.sum(F.col("w") * F.col("w")).cast("double") / (F.sum("w").cast("double") * F.sum("w").cast("double")) * 10000).alias("hhi"))


@query("top_sector_shares", f"SELECT sector, CAST(abs(notional) AS DOUBLE) AS notional FROM {_SECTORS} ORDER BY 2 DESC, 1 LIMIT 3")
def top_sector_shares(spark, sf):
    return _sectors(spark, sf).select("sector", F.abs("notional").cast("double").alias("notional")).orderBy(F.desc("notional"), "sector").limit(3)


# -- the eight showcase aggregates -----------------------------------------------------


def _showcase(number: int, sql: str, build):
    query(f"showcase_q{number}", sql)(lambda spark, sf: build(table(spark, sf, "lineitem" if "lineitem" in sql else "orders")))


_showcase(1, "SELECT count(*) AS n FROM lineitem", lambda t: t.agg(F.count("*").alias("n")))
_showcase(2, f"SELECT {_sum('l_extendedprice')} AS a, {_sum('l_tax')} AS b, {_sum('l_discount')} AS c FROM lineitem", lambda t: t.agg(total("l_extendedprice").alias("a"), total("l_tax").alias("b"), total("l_discount").alias("c")))
_showcase(3, "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1", lambda t: t.where("l_returnflag = 'R' AND l_linenumber = 1").agg(F.count("*").alias("n")))
_showcase(4, f"SELECT {_sum('l_extendedprice')} AS s FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 50000 AND l_returnflag IN ('A', 'N')", lambda t: t.where("l_extendedprice BETWEEN 1000 AND 50000 AND l_returnflag IN ('A', 'N')").agg(total("l_extendedprice").alias("s")))
_showcase(5, "SELECT count(*) AS n FROM orders WHERE o_orderpriority LIKE '1-U%' AND o_orderstatus IN ('F', 'O')", lambda t: t.where("o_orderpriority LIKE '1-U%' AND o_orderstatus IN ('F', 'O')").agg(F.count("*").alias("n")))
_showcase(6, f"SELECT {_sum('o_totalprice')} / count(*) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders", lambda t: t.agg((total("o_totalprice") / F.count("*")).alias("mean"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")))
_showcase(7, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'", lambda t: t.where("o_orderstatus = 'P' OR o_orderpriority = '5-LOW'").agg(F.count("*").alias("n")))
_showcase(8, f"SELECT CAST(sum(CAST(l_extendedprice AS {_D}) + CAST(l_tax AS {_D}) + CAST(l_quantity AS {_D}) - CAST(l_discount AS {_D})) AS DOUBLE) AS s FROM lineitem", lambda t: t.agg(F.sum(cents("l_extendedprice") + cents("l_tax") + cents("l_quantity") - cents("l_discount")).cast("double").alias("s")))
