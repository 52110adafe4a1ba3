"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from linkframe import queries_links, queries_more, queries_pipeline  # noqa: F401 - queries_more adds to queries_links
from linkframe.operators.linkset import Linkset
from linkframe.schema import table
from linkframe.sources import storage

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for m in (queries_pipeline, queries_links) for n in m.QUERIES])
def test_no_products_and_no_row_functions(spark, name):
    df = {**queries_pipeline.QUERIES, **queries_links.QUERIES}[name](spark, SF)
    text = plan(df)
    assert not [x for x in FORBIDDEN if x in text]
    assert len(set(df.columns)) == len(df.columns)


def test_match_reaches_the_scan(spark):
    text = plan(storage.from_two_tables(table(spark, SF, "relationship"), None).match("o", "r").df.select("target"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(origin,o\).*EqualTo\(rel,r\)", text)
    assert re.search(r"ReadSchema: struct<origin:string,rel:string,target:string>", text)


def test_match_reaches_the_database(spark):
    from linkframe.queries_more import _database

    url, props = _database(spark, Linkset.of(spark, [("a", "r", "t", {"n": "v"}), ("b", "r", "t", {"n": "w"})]), "name VARCHAR(500), value VARCHAR(500)")
    df = storage.match_jdbc(spark, url, "x", props, origin="a", attrs={"n": "v"})
    text = plan(df)
    assert re.search(r"PushedFilters: \[.*EqualTo\(origin,a\)", text) and re.search(r"PushedFilters: \[.*EqualTo\(value,v\)", text)
    assert [r.origin for r in df.collect()] == ["a"]


def test_follow_star_is_one_aggregation(spark):
    from linkframe.operators.graph import follow_star

    text = plan(follow_star(storage.from_two_tables(table(spark, SF, "relationship"), None), ["a", "b", "c"]))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_dedup_is_a_hash_shuffle_of_identity_only(spark):
    text = plan(Linkset.of(spark, [("a", "b", "c")]).unique().df)
    assert text.count("Exchange") == 1


def test_tree_has_rounds_of_bounded_fan_in(spark):
    from pyspark.sql import functions as F

    from linkframe.operators.tree_agg import tree_aggregate

    df = spark.range(0, 1000, 1, 20).withColumn("k", F.col("id") % 3)
    out = tree_aggregate(df, ["k"], {"n": (F.count(F.lit(1)), F.sum)}, 20, fan_in=3)
    assert plan(out).count("Exchange hashpartitioning") == 4  # leaves, then 20 -> 7 -> 3 -> 1
    assert sorted(map(tuple, out.collect())) == [(0, 334), (1, 333), (2, 333)]


def test_hot_reference_is_split(spark, skewed):
    from pyspark.sql import functions as F

    from linkframe.operators.orphans import orphan_references

    keys = spark.range(20000).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("k"), F.lit("2021-01-01").cast("timestamp").alias("s"), F.lit(None).cast("timestamp").alias("e"))
    out = orphan_references(skewed, keys, ["origin"], ["k"], "at", "s", "e")
    assert len(out.collect()) == 66_667
    assert "skew=true" in plan(out)


@pytest.mark.parametrize("name", ["two_tables_round_trip_whole", "nested_round_trip_whole"])
def test_round_trips_keep_every_link(spark, name):
    """Links without attributes, repeated ones and nulls too, as often as they stand."""
    r, a = table(spark, SF, "relationship"), table(spark, SF, "attribute")
    want = r.join(a.where("rawid is not null").withColumnRenamed("rawid", "of"), r.rawid == F.col("of"), "left").select("origin", "rel", "target", "name", "value")
    got = queries_links.QUERIES[name](spark, SF)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert got.where("name is null").count() and got.select("rel").distinct().count() > 2
