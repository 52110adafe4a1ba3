"""Relational tables as links: a row is a resource, a column a rel, a foreign key a link to another resource."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkframe.operators.linkset import Linkset, attrs_column
from linkframe.schema import TYPE, table

BASE = "tpch:"


def resource(name: str, key: Column) -> Column:
    return F.concat(F.lit(f"{BASE}{name}/"), key.cast("string"))


def rel(name: str) -> str:
    return f"{BASE}vocab/{name}"


def rows_as_links(df: DataFrame, name: str, key: str, columns: Sequence[str], refs: Mapping[str, str] | None = None, typed: bool = True) -> Linkset:
    """Links of a table with a unique key: one pass, exploded over the columns asked for, so only these are read. ``refs``:
    column -> table it refers to. Nulls make no link."""
    refs = refs or {}
    items = [F.struct(F.lit(rel(c)).alias("r"), (resource(refs[c], F.col(c)) if c in refs else F.col(c).cast("string")).alias("t"), F.lit(c in refs).alias("i")) for c in [*columns, *[c for c in refs if c not in columns]]]
    if typed:
        items.append(F.struct(F.lit(TYPE).alias("r"), F.lit(rel(name)).alias("t"), F.lit(True).alias("i")))
    flat = df.select(F.col(key).alias("_k"), F.explode(F.array(*items)).alias("l")).where("l.t is not null")
    return Linkset.from_columns(flat, resource(name, F.col("_k")), F.col("l.r"), F.col("l.t"), None, F.col("l.i"), F.col("_k"))


def rows_as_edges(df: DataFrame, origin: Column, rel_: Column, target: Column, attrs: Mapping[str, Column]) -> Linkset:
    """Links that are rows themselves, the other columns their attributes; equal rows stay."""
    return Linkset.from_columns(df, origin, rel_, target, attrs_column(attrs), F.lit(True))


def star(spark: SparkSession, d: str) -> Linkset:
    """Customers, orders, nations and regions."""
    parts = [
        rows_as_links(table(spark, d, "customer"), "customer", "c_custkey", ["c_name", "c_mktsegment"], {"c_nationkey": "nation"}), rows_as_links(table(spark, d, "orders"), "orders", "o_orderkey", ["o_orderpriority", "o_orderstatus"], {"o_custkey": "customer"}),
        rows_as_links(table(spark, d, "nation"), "nation", "n_nationkey", ["n_name"], {"n_regionkey": "region"}), rows_as_links(table(spark, d, "region"), "region", "r_regionkey", ["r_name"]),
    ]
    return parts[0].union(*parts[1:], dedup=False)


def places(spark: SparkSession, d: str) -> Linkset:
    """Customer -> nation -> region under one rel."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    a = Linkset.from_columns(c, resource("customer", F.col("c_custkey")), F.lit(rel("in")), resource("nation", F.col("c_nationkey")), None, F.lit(True))
    return a.union(Linkset.from_columns(n, resource("nation", F.col("n_nationkey")), F.lit(rel("in")), resource("region", F.col("n_regionkey")), None, F.lit(True)), dedup=False)


def event_links(spark: SparkSession, d: str) -> Linkset:
    """user -> event type -> event, with time, value and the number in ``props`` as attributes."""
    e = table(spark, d, "events")
    return rows_as_edges(e, resource("user", F.col("user_id")), F.concat(F.lit(rel("")), "event_type"), resource("event", F.col("event_id")), {"k": F.get_json_object("props", "$.k"), "value": F.col("value")})


def item_links(spark: SparkSession, d: str) -> Linkset:
    """order -> part, with line number, supplier, flags and quantity as attributes."""
    x = table(spark, d, "lineitem")
    names = {"linenumber": "l_linenumber", "suppkey": "l_suppkey", "returnflag": "l_returnflag", "linestatus": "l_linestatus", "quantity": "l_quantity"}
    return rows_as_edges(x, resource("orders", F.col("l_orderkey")), F.lit(rel("item")), resource("part", F.col("l_partkey")), {k: F.col(v) for k, v in names.items()})
