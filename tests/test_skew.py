"""Joins with hot and null keys."""

import pytest
from pyspark.sql import functions as F

from vocatlas.operators import adjudicate, graph, index, skew
from vocatlas.sources import catalogs


@pytest.fixture
def fixed(spark):
    """As many tasks as partitions, and no broadcast that Spark chooses."""
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def most(df):
    """Rows of the fullest task, and all rows."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n), sum(n)


def test_hot_keys_are_dealt_to_several_tasks(spark, fixed, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    rows = spark.range(2000).select("id", F.when(F.col("id") % 4 != 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    by_key = spark.createDataFrame([("hot", 1), ("8", 2), ("other", 3)], "k string, v int")
    got = skew.left_join(rows, by_key, ["k"])
    assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, rows.join(by_key, "k", "left").select("id", "k", "v").collect()))
    assert most(got)[1] == 2000 and most(got)[0] < 900


def test_proposals_without_identifier_or_of_one_term_are_not_one_tasks(spark, fixed, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    kind = F.when(F.col("id") % 2 == 0, "structural").otherwise("product")
    term = F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "keys").otherwise(F.concat(F.lit("CWE-x"), F.col("id").cast("string")))
    p = spark.range(2000).select("id", term.alias("term"), kind.alias("kind"))
    docs = index.build(spark.createDataFrame([(1, "keys"), (2, "cwe")], "doc_id long, text string"))
    got = adjudicate.adjudicate(p, graph.build(catalogs.empty(spark)), docs.term_stats, 20)
    assert most(got) == (most(got)[0], 2000) and most(got)[0] < 900
    seen = {(r.t.term, r.t.kind, r.t.accepted, r.t.reject_reason, r.t.doc_freq) for r in got.where("id in (0, 3, 5, 6, 7, 10, 11, 14)").collect()}
    assert seen == {
        (None, "colloquial", True, None, 0), ("keys", "product", True, None, 1), ("keys", "colloquial", True, None, 1), ("CWE-x5", "product", True, None, 1),
        ("CWE-x7", "product", True, None, 1), ("CWE-x11", "product", True, None, 1), ("CWE-x14", "structural", False, "malformed_id", None),
    }
