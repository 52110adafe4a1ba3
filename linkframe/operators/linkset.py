"""A set of links as a DataFrame: matching, lookups, set operations, mutation, grouping."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkframe.schema import ITEM, LABEL, LINK_SCHEMA, TYPE, cut

PARTS = ("origin", "rel", "target")
IDENTITY = [*PARTS, "attrs"]
NO_ATTRS = "cast(array() as array<struct<name:string,value:string>>)"

Pattern = str | Iterable[str] | Column | None


def attrs_column(pairs: Mapping[str, Column | str]) -> Column:
    """A sorted attribute array of named columns; null values are left out."""
    entries = [F.struct(F.lit(k).alias("name"), (v if isinstance(v, Column) else F.lit(v)).cast("string").alias("value")) for k, v in sorted(pairs.items())]
    return F.filter(F.array_sort(F.array(*entries)), lambda e: e.value.isNotNull()) if entries else F.expr(NO_ATTRS)


def attr(attrs: Column, name: str) -> Column:
    """The first value of an attribute, null without one."""
    return F.get(F.filter(attrs, lambda e: e.getField("name") == name), F.lit(0)).getField("value")


def has_attrs(attrs: Column, wanted: Mapping[str, str]) -> Column:
    def has(name: str, value: str) -> Column:
        return F.exists(attrs, lambda e: (e.getField("name") == name) & (e.getField("value") == value))

    out = F.lit(True)
    for k, v in wanted.items():
        out &= has(k, v)
    return out


def digest() -> Column:
    """A link's identity in 16 bytes, with nulls in their places."""
    return F.unhex(F.substring(F.sha2(F.to_json(F.struct(*IDENTITY), {"ignoreNullFields": "false"}), 256), 1, 32))


class Linkset:
    """A thin wrapper: ``df`` has the columns of ``LINK_SCHEMA`` and stays a DataFrame for everything else. Nothing is
    executed before ``df`` is; ``size`` and ``equals`` are the only methods that run a job."""

    def __init__(self, df: DataFrame):
        self.df = df

    # making

    @staticmethod
    def of(spark: SparkSession, links: Iterable[Sequence]) -> Linkset:
        """From tuples (origin, rel, target[, attributes[, target is an IRI]]); the place in the list is the link's id."""
        rows = []
        for i, x in enumerate(links):
            o, r, t, *more = x
            if not o or not r:
                raise ValueError("a link needs an origin and a relationship")
            attrs = sorted((more[0] if more else None or {}).items()) if more and more[0] else []
            rows.append((i, o, r, None if t is None else str(t), bool(more[1]) if len(more) > 1 else None, [(k, v) for k, v in attrs]))
        return Linkset(spark.createDataFrame(rows, LINK_SCHEMA))

    @staticmethod
    def empty(spark: SparkSession) -> Linkset:
        return Linkset(spark.createDataFrame([], LINK_SCHEMA))

    @staticmethod
    def from_columns(df: DataFrame, origin: Column, rel: Column, target: Column, attrs: Column | None = None, is_iri: Column | None = None, link_id: Column | None = None) -> Linkset:
        return Linkset(
            df.select(
                (link_id if link_id is not None else F.lit(None)).cast("bigint").alias("link_id"), origin.cast("string").alias("origin"), rel.cast("string").alias("rel"), target.cast("string").alias("target"),
                (is_iri if is_iri is not None else F.lit(None)).cast("boolean").alias("target_is_iri"), (attrs if attrs is not None else F.expr(NO_ATTRS)).alias("attrs"),
            )
        )

    # scanning

    def size(self) -> int:
        return self.df.count()

    def count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n_links"))

    def counts(self, by: str) -> DataFrame:
        """(by, n): links of each value of a part; a few values that hold most of the links leave a task as one state each."""
        return self.df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))

    def at(self, link_id: int) -> DataFrame:
        return self.df.where(F.col("link_id") == link_id)

    def _part(self, name: str, p: Pattern) -> Column | None:
        if p is None or (isinstance(p, str) and p == ""):
            return None
        if isinstance(p, Column):
            return p
        if isinstance(p, str):
            return F.col(name) == p
        values = list(p)
        return F.col(name).isin(values) if values else None

    def match(self, origin: Pattern = None, rel: Pattern = None, target: Pattern = None, attrs: Mapping[str, str] | None = None, include_ids: bool = True) -> Linkset:
        """Links that agree with every given part: a value, a set of values, or a predicate. An empty value or set is a
        wildcard. All given attributes must be there with the given value. The predicates reach the scan."""
        df = self.df
        for name, p in zip(PARTS, (origin, rel, target)):
            if (c := self._part(name, p)) is not None:
                df = df.where(c)
        if attrs:
            df = df.where(has_attrs(F.col("attrs"), attrs))
        return Linkset(df if include_ids else df.withColumn("link_id", F.lit(None).cast("bigint")))

    multimatch = match

    def match_any(self, part: str, values: DataFrame) -> Linkset:
        """The same for a set too large for a list: the first column of ``values``, as a semi-join."""
        if part not in PARTS:
            raise ValueError(part)
        keys = values.select(F.col(f"`{values.columns[0]}`").alias("_key"))
        return Linkset(self.df.join(keys, F.col(part) == F.col("_key"), "left_semi"))

    def where(self, predicate: Column | str) -> Linkset:
        return Linkset(self.df.where(predicate))

    def only_rels(self, rels: Iterable[str], keep_types: bool = True) -> Linkset:
        rels = list(rels)
        return Linkset(self.df.where(F.col("rel").isin(rels + [TYPE] if keep_types else rels)))

    def without_rels(self, rels: Iterable[str]) -> Linkset:
        return Linkset(self.df.where(~F.col("rel").isin(list(rels))))

    def complete(self) -> Linkset:
        """Links of which no part is null."""
        return Linkset(self.df.na.drop(subset=list(PARTS)))

    # looking up

    def column(self, part: str) -> DataFrame:
        return self.df.select(part).distinct()

    def targets(self, origin: Pattern = None, rel: Pattern = None) -> DataFrame:
        return self.match(origin, rel).df.select("origin", "rel", "target")

    def origins_of(self, rel: Pattern, target: Pattern) -> DataFrame:
        return self.match(None, rel, target).df.select("origin").distinct()

    def first(self, by: Sequence[str], part: str = "target") -> DataFrame:
        """The part of the first link (least id) of each group: ``first(['origin', 'rel'])`` is a lookup of one value."""
        return self.df.groupBy(*by).agg(F.min_by(part, F.struct("link_id", part)).alias(part))

    def types(self, origin: Pattern = None, type_rel: str = TYPE) -> DataFrame:
        return self.targets(origin, type_rel).select("origin", F.col("target").alias("type"))

    def labels(self, origin: Pattern = None, label_rel: str = LABEL) -> DataFrame:
        return self.targets(origin, label_rel).select("origin", F.col("target").alias("label"))

    def origins(self, of_types: Iterable[str] | str | None = None, type_rel: str = TYPE) -> DataFrame:
        """Distinct origins; '*': those with any type; a set: those with one of the types. One filtered pass."""
        if not of_types:
            return self.df.select("origin").distinct()
        typed = self.match(None, type_rel, None if of_types == "*" else ({of_types} if isinstance(of_types, str) else of_types))
        return typed.df.select("origin").distinct()

    def list_items(self, item_rel: str = ITEM) -> DataFrame:
        """(origin, items): the targets of item links in order of their ids."""
        pairs = F.array_sort(F.collect_list(F.struct("link_id", "target")))
        return self.match(None, item_rel).df.groupBy("origin").agg(F.transform(pairs, lambda x: x.target).alias("items"))

    # grouping

    def index(self, rel: str, as_set: bool = False, with_attrs: bool = False) -> DataFrame:
        """(origin, values) of one rel, sorted."""
        value = F.struct("target", "attrs") if with_attrs else F.col("target")
        return self.match(None, rel).df.groupBy("origin").agg(F.array_sort(F.collect_set(value) if as_set else F.collect_list(value)).alias("values"))

    def by_origin(self) -> DataFrame:
        """(origin, links): all links of an origin, sorted."""
        return self.df.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("rel", "target", "attrs"))).alias("links"))

    def nested(self) -> DataFrame:
        """(origin, rels: rel -> targets with attributes): the document form."""
        inner = self.df.groupBy("origin", "rel").agg(F.array_sort(F.collect_list(F.struct("target", "attrs"))).alias("targets"))
        return inner.groupBy("origin").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rel", "targets")))).alias("rels"))

    @staticmethod
    def from_nested(df: DataFrame) -> Linkset:
        flat = df.select("origin", F.explode("rels").alias("rel", "targets")).select("origin", "rel", F.explode("targets").alias("t"))
        return Linkset.from_columns(flat, F.col("origin"), F.col("rel"), F.col("t.target"), F.col("t.attrs"))

    def pivot(self, columns: Mapping[str, str], sep: str = "|", of_types: Iterable[str] | None = None, type_rel: str = TYPE) -> DataFrame:
        """One row per origin with a column per rel, several values joined by ``sep`` in order: one aggregation, no join.
        ``columns``: name -> rel."""
        aggs = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("rel") == r, F.col("target")))), sep).alias(n) for n, r in columns.items()]
        kept = self.df.where(F.col("rel").isin(list(columns.values()) + ([type_rel] if of_types else [])))
        if of_types:
            aggs.append(F.max((F.col("rel") == type_rel) & F.col("target").isin(list(of_types))).alias("_typed"))
        out = kept.groupBy("origin").agg(*aggs)
        return out.where("_typed").drop("_typed") if of_types else out

    def flatten(self) -> DataFrame:
        """(origin, rel, target, name, value): a row per attribute, one with nulls for links without."""
        return self.df.select(*PARTS, F.explode_outer("attrs").alias("a")).select(*PARTS, F.col("a.name").alias("name"), F.col("a.value").alias("value"))

    def reified(self, about: str = "urn:link:") -> Linkset:
        """The same without attributes: each attribute is a link of its own, from a resource that stands for the link and
        names its origin, rel and target."""
        from linkframe.schema import RDF_NS

        rid = F.concat(F.lit(about), F.lower(F.hex(digest())))
        noted = self.df.where(F.size("attrs") > 0).withColumn("_rid", rid)
        parts = F.array(*[F.struct(F.lit(RDF_NS + n).alias("name"), F.col(c).alias("value")) for n, c in (("subject", "origin"), ("predicate", "rel"), ("object", "target"))])
        own = noted.select("_rid", F.explode(F.concat(parts, "attrs")).alias("a"))
        plain = Linkset(self.df.withColumn("attrs", F.expr(NO_ATTRS)))
        return plain.union(Linkset.from_columns(own, F.col("_rid"), F.col("a.name"), F.col("a.value"), None, F.lit(False)), dedup=False)

    def hashed(self) -> DataFrame:
        """With ``link_hash``, a digest of the link's identity in 32 hexadecimal digits."""
        return self.df.withColumn("link_hash", F.lower(F.hex(digest())))

    def refinements(self, rel: str) -> DataFrame:
        """(broader, narrower): what refines each target, sorted."""
        return self.match(None, rel).df.groupBy(F.col("target").alias("broader")).agg(F.array_sort(F.collect_set("origin")).alias("narrower"))

    # sets and changes

    def numbered(self) -> Linkset:
        """Ids 0, 1, ... in the order of the ids there were: ranges are sorted apart, and each starts where the counts of those
        before it end. The sorted links are a written table, so that the ids cannot change; one count per range is gathered."""
        order = ["link_id", *PARTS]
        placed = self.df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        placed = cut(placed.withColumn("_part", F.shiftright("_at", 33)))
        offsets, total = [], 0
        for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
            offsets.append((r["_part"], total - (r["_part"] << 33)))
            total += r.n
        start = F.try_element_at(F.map_from_entries(F.array(*[F.struct(F.lit(p).cast("bigint"), F.lit(o).cast("bigint")) for p, o in offsets])), F.col("_part")) if offsets else F.lit(0)
        return Linkset(placed.withColumn("link_id", F.col("_at") + start).select(*[f.name for f in LINK_SCHEMA.fields]))

    def unique(self) -> Linkset:
        """One link of each origin, rel, target and attributes, the first. Whether a target is an IRI does not count."""
        kept = self.df.groupBy(*IDENTITY).agg(F.min("link_id").alias("link_id"), F.max("target_is_iri").alias("target_is_iri"))
        return Linkset(kept.select(*[f.name for f in LINK_SCHEMA.fields]))

    def union(self, *others: Linkset, dedup: bool = True) -> Linkset:
        df = self.df
        for x in others:
            df = df.unionByName(x.df)
        return Linkset(df).unique() if dedup else Linkset(df)

    def copy(self, contents: bool = True) -> Linkset:
        """The same set, which nothing can change, or an empty one."""
        return Linkset(self.df if contents else self.df.limit(0))

    def add(self, links: Linkset, dedup: bool = True, index: int | None = None) -> Linkset:
        """``links``, in their order, with ids after all that are there, or from ``index`` on, and then those from there on move up.
        With ``dedup`` links that are there already, and repeated ones, are not added. Empty origins or rels are refused
        by ``Linkset.of``."""
        new = (links.minus(self).unique() if dedup else links).numbered()
        if index is None:
            start = F.coalesce(self.df.agg(F.max("link_id") + 1).scalar(), F.lit(0))
            return Linkset(self.df.unionByName(new.df.withColumn("link_id", F.col("link_id") + start)))
        count = new.df.agg(F.count(F.lit(1))).scalar()
        moved = self.df.withColumn("link_id", F.when(F.col("link_id") >= index, F.col("link_id") + count).otherwise(F.col("link_id")))
        return Linkset(moved.unionByName(new.df.withColumn("link_id", F.col("link_id") + index)))

    def minus(self, other: Linkset) -> Linkset:
        keys = other.df.select(*IDENTITY).distinct()
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in IDENTITY]
        return Linkset(self.df.alias("a").join(keys.alias("b"), on, "left_anti"))

    def intersect(self, other: Linkset) -> Linkset:
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in IDENTITY]
        return Linkset(self.df.alias("a").join(other.df.select(*IDENTITY).distinct().alias("b"), on, "left_semi"))

    def remove(self, link_ids: Iterable[int] | DataFrame) -> Linkset:
        if isinstance(link_ids, DataFrame):
            keys = link_ids.select(F.col(f"`{link_ids.columns[0]}`").alias("_id"))
            return Linkset(self.df.join(keys, F.col("link_id") == F.col("_id"), "left_anti"))
        return Linkset(self.df.where(~F.coalesce(F.col("link_id").isin(list(link_ids)), F.lit(False))))

    def differences(self, other: Linkset) -> DataFrame:
        """Links, with their number and side, in which two sets differ; being an IRI counts here."""
        cols = [*IDENTITY, F.coalesce("target_is_iri", F.lit(False)).alias("target_is_iri")]
        a = self.df.select(*cols, F.lit(1).alias("side"))
        b = other.df.select(*cols, F.lit(-1).alias("side"))
        return a.unionByName(b).groupBy(*IDENTITY, "target_is_iri").agg(F.sum("side").alias("surplus")).where("surplus <> 0")

    def equals(self, other: Linkset) -> bool:
        return self.differences(other).limit(1).count() == 0

    def replace_origins(self, mapping: Mapping[str, str]) -> Linkset:
        from linkframe.functions.text import lookup

        return Linkset(self.df.withColumn("origin", lookup(F.col("origin"), mapping, F.col("origin"))))

    def replace_origins_from(self, mapping: DataFrame, old: str = "old", new: str = "new") -> Linkset:
        """The same from a table, for mappings too large for a constant."""
        m = mapping.select(F.col(old).alias("_old"), F.col(new).alias("_new"))
        return Linkset(self.df.join(m, F.col("origin") == F.col("_old"), "left").withColumn("origin", F.coalesce("_new", "origin")).select(*self.df.columns))

    def replace_entity(self, old: str, new: str) -> Linkset:
        """A resource renamed wherever it stands: origins, targets and attribute values."""
        swap = lambda c: F.when(c == old, F.lit(new)).otherwise(c)
        attrs = F.array_sort(F.transform("attrs", lambda e: F.struct(e.getField("name").alias("name"), swap(e.getField("value")).alias("value"))))
        return Linkset(self.df.withColumns({"origin": swap(F.col("origin")), "target": swap(F.col("target")), "attrs": attrs}))

    def duplicate(self, old: str, new: str, predicate: Column | None = None) -> Linkset:
        """These links and copies of those of ``old`` (that fulfil the predicate) under the origin ``new``."""
        kept = self.df.where(F.col("origin") == old)
        if predicate is not None:
            kept = kept.where(predicate)
        return Linkset(self.df.unionByName(kept.withColumns({"origin": F.lit(new), "link_id": F.lit(None).cast("bigint")})))
