"""Joins that must read whole tables."""

from collections import Counter

from deltaweave.queries import QUERIES


def test_null_keys_join_all_orders(spark, sf_dir):
    status = Counter(r.o_orderstatus for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus").collect())
    assert QUERIES["join_null_keys"](spark, sf_dir).first().n == sum(n * n for s, n in status.items() if s not in ("O", None))


def test_incremental_outer_join_passes_all_orders(spark, sf_dir):
    """All but those that the last step takes back."""
    keys = lambda df: {r.o_orderkey for r in df.where("o_orderkey IS NOT NULL").select("o_orderkey").collect()}
    assert keys(QUERIES["incr_full"](spark, sf_dir)) == keys(spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 10 <> 5"))


def test_joins_read_all_documents(spark, sf_dir):
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    docs, labels = (ids(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in ("documents", "labels"))
    for name, wanted in (("inner", docs & labels), ("left", docs), ("right", docs), ("full", docs), ("semi", docs & labels)):
        assert ids(QUERIES[f"join_{name}"](spark, sf_dir)) - {None} == wanted
