"""Where links are kept: the two-table relational layout, Parquet tables, JDBC databases, shortened IRIs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkframe.operators.linkset import NO_ATTRS, Linkset
from linkframe.schema import cut


def from_two_tables(relationship: DataFrame, attribute: DataFrame | None, origin: str = "origin", rel: str = "rel", target: str = "target", is_iri: Column | None = None) -> Linkset:
    """Links with their attributes from ``relationship(rawid, origin, rel, target)`` and ``attribute(rawid, name, value)``:
    one aggregation of the attributes, one join. Links without attributes stay; attributes without link do not."""
    attrs = F.expr(NO_ATTRS)
    df = relationship
    if attribute is not None:
        own = attribute.where("rawid is not null").groupBy(F.col("rawid").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("_attrs"))
        df = df.join(own, F.col("rawid") == F.col("_of"), "left")
        attrs = F.coalesce("_attrs", attrs)
    return Linkset.from_columns(df, F.col(origin), F.col(rel), F.col(target), attrs, is_iri, F.col("rawid"))


def to_two_tables(links: Linkset) -> tuple[DataFrame, DataFrame]:
    df = links.df.select(F.coalesce("link_id", F.monotonically_increasing_id()).alias("rawid"), "origin", "rel", "target", "attrs")
    return df.select("rawid", F.lit(None).cast("string").alias("id"), "origin", "rel", "target"), df.select("rawid", F.explode("attrs").alias("a")).select("rawid", "a.name", "a.value")


def match_two_tables(relationship: DataFrame, attribute: DataFrame, origin: str | None = None, rel: str | None = None, target: str | None = None, attrs: Mapping[str, str] | None = None) -> DataFrame:
    """The same match on the tables themselves: equalities are pushed to the scan, each attribute is a semi-join."""
    df = relationship
    for c, v in (("origin", origin), ("rel", rel), ("target", target)):
        if v:
            df = df.where(F.col(c) == v)
    for k, v in (attrs or {}).items():
        df = df.join(attribute.where((F.col("name") == k) & (F.col("value") == v)).select("rawid"), "rawid", "left_semi")
    return df


def save(links: Linkset, path: str, by_rel: bool = False, mode: str = "overwrite") -> None:
    """As Parquet, origins together and sorted so that their statistics prune; ``by_rel`` a folder per rel (for few rels)."""
    w = links.df.repartitionByRange("origin").sortWithinPartitions("origin", "rel").write.mode(mode)
    (w.partitionBy("rel") if by_rel else w).parquet(path)


def load(spark: SparkSession, path: str) -> Linkset:
    from linkframe.schema import LINK_SCHEMA

    return Linkset(spark.read.parquet(path).select(*[f.name for f in LINK_SCHEMA.fields]))


def save_table(links: Linkset, name: str, buckets: int, mode: str = "overwrite", path: str | None = None) -> None:
    """As a table bucketed by origin: joins and groupings by origin then need no shuffle, a lookup of one origin reads one
    bucket. ``path``: where, if not in the warehouse."""
    w = links.df.write.mode(mode).bucketBy(buckets, "origin").sortBy("origin", "rel")
    (w.option("path", path) if path else w).saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def read_jdbc(spark: SparkSession, url: str, space: str = "", properties: Mapping[str, str] | None = None, partitions: int = 1, bounds: tuple[int, int] | None = None) -> Linkset:
    """From a database in the two-table layout. With ``bounds`` of rawid the reads are split."""
    props = dict(properties or {})
    split = {"column": "rawid", "lowerBound": bounds[0], "upperBound": bounds[1], "numPartitions": partitions} if bounds else {}
    prefix = f"{space}_" if space else ""
    return from_two_tables(spark.read.jdbc(url, f"{prefix}relationship", properties=props, **split), spark.read.jdbc(url, f"{prefix}attribute", properties=props, **split))


def match_jdbc(spark: SparkSession, url: str, space: str = "", properties: Mapping[str, str] | None = None, **parts) -> DataFrame:
    """``match_two_tables`` on the tables of a database, which gets the equalities as its own filters."""
    prefix = f"{space}_" if space else ""
    read = lambda name: spark.read.jdbc(url, prefix + name, properties=dict(properties or {}))
    return match_two_tables(read("relationship"), read("attribute"), **parts)


def write_jdbc(links: Linkset, url: str, space: str = "", properties: Mapping[str, str] | None = None, mode: str = "append", column_types: tuple[str, str] | None = None) -> None:
    """``column_types``: of the two tables where they are created, such as ``('origin VARCHAR(2000)', 'name VARCHAR(500)')``; in some
    databases texts of unbounded length cannot be compared."""
    prefix = f"{space}_" if space else ""
    for df, name, types in zip(to_two_tables(links), ("relationship", "attribute"), column_types or (None, None)):
        (df.write.option("createTableColumnTypes", types) if types else df.write).jdbc(url, prefix + name, mode=mode, properties=dict(properties or {}))


def shortened(links: Linkset, parts: Iterable[str] = ("rel", "target")) -> tuple[Linkset, DataFrame]:
    """Rels and targets split at their last '/' and the first half replaced by a number from a table (prefix, n): ``{n}tail``;
    braces that stand in the text are doubled. Only prefixes of more than one use are worth it, so others stay."""
    parts = list(parts)
    head = lambda c: F.regexp_extract(c, r"^(.*/)[^/]*$", 1)
    seen = None
    for p in parts:
        x = links.df.select(head(F.col(p)).alias("prefix")).where("prefix <> ''")
        seen = x if seen is None else seen.unionByName(x)
    table = seen.groupBy("prefix").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").select("prefix", F.monotonically_increasing_id().alias("n"))
    table = cut(table)  # the numbers are given once
    df = links.df
    doubled = lambda c: F.replace(F.replace(c, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    for p in parts:
        t = table.select(F.col("prefix").alias("_p"), F.col("n").alias("_n"))
        df = df.withColumn("_h", head(F.col(p))).join(t, F.col("_h") == F.col("_p"), "left")
        tail = doubled(F.expr(f"substring(`{p}`, length(_h) + 1)"))
        df = df.withColumn(p, F.when(F.col("_n").isNotNull(), F.concat(F.lit("{"), F.col("_n").cast("string"), F.lit("}"), tail)).otherwise(doubled(F.col(p)))).drop("_h", "_p", "_n")
    return Linkset(df), table


def restored(links: Linkset, table: DataFrame, parts: Iterable[str] = ("rel", "target")) -> Linkset:
    df = links.df
    single = lambda c: F.replace(F.replace(c, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    for p in parts:
        t = table.select(F.col("prefix").alias("_p"), F.col("n").alias("_n"))
        number = F.regexp_extract(F.col(p), r"^\{(\d+)\}", 1)
        df = df.withColumn("_k", F.when(number != "", number.cast("bigint"))).join(t, F.col("_k") == F.col("_n"), "left")
        tail = single(F.regexp_replace(F.col(p), r"^\{\d+\}", ""))
        df = df.withColumn(p, F.when(F.col("_p").isNotNull(), F.concat("_p", tail)).otherwise(single(F.col(p)))).drop("_k", "_p", "_n")
    return Linkset(df)
