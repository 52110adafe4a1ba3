"""CSV and JSON rows into links through a literate template, which is compiled once into column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkframe.functions.iri import percent_encode
from linkframe.operators.linkset import Linkset
from linkframe.schema import LINK_SCHEMA, TYPE, shared_dir
from linkframe.sources import literate

_HOLE = re.compile(r"\{\{\s*_\[[\"'](.+?)[\"']\]\s*\}\}|\{\{\s*([\w.]+)\s*\}\}|\{([^{}\n]+)\}")
_MARK = re.compile("(\\d+)")


def adapted(name: str) -> str:
    """A column name as templates may write it: spaces to '_', other characters percent-encoded."""
    return percent_encode(name.replace(" ", "_")).replace("[", "%5B").replace("]", "%5D")


def slugged(name: str) -> str:
    return re.sub(r"\W+", "_", name)


def _names(df: DataFrame) -> dict[str, Column]:
    """All ways to name the columns of ``df``, fields of structs by a dotted path; a name that clashes gets a '_'."""
    out: dict[str, Column] = {}

    def walk(prefix: str, col: Column, dtype) -> None:
        for f in dtype.fields if hasattr(dtype, "fields") else []:
            name = f"{prefix}.{f.name}" if prefix else f.name
            here = col.getField(f.name) if prefix else F.col(f"`{f.name}`")
            for n in dict.fromkeys((name, adapted(name), slugged(name))):
                while n in out:
                    n += "_"
                out[n] = here.cast("string") if not hasattr(f.dataType, "fields") else here
            walk(name, here, f.dataType)

    walk("", F.lit(None), df.schema)
    return out


def _filled(text: str, holes: list[Column]) -> Column:
    parts = _MARK.split(text)
    return F.concat(*[F.lit(p) if i % 2 == 0 else holes[int(p)] for i, p in enumerate(parts) if i % 2 or p]) if len(parts) > 1 else F.lit(text)


def ingest(df: DataFrame, template: str, prerow: Callable[[DataFrame], DataFrame] | None = None, row_id: Column | None = None, tap: Observation | None = None, metrics: Sequence[Column] = (), **options) -> Linkset:
    """One set of links from all rows. ``{name}``, ``{{ name }}`` and ``{{ _["name"] }}`` are holes. A link of which a hole
    is null is left out. ``prerow`` may change, drop or multiply rows first; ``tap`` sees ``metrics`` of the rows as they pass. Rows are exploded into their links in one
    pass; the text is not parsed again for them."""
    if prerow:
        df = prerow(df)
    if tap is not None:
        df = df.observe(tap, *(metrics or [F.count(F.lit(1)).alias("rows")]))
    names, holes = _names(df), []

    def hole(m: re.Match) -> str:
        name = m[1] or m[2] or m[3]
        if name not in names:
            raise ValueError(f"no column {name!r}")
        holes.append(names[name])
        return f"{len(holes) - 1}"

    links, _ = literate.parse(_HOLE.sub(hole, template), **options)
    if not links:
        return Linkset.empty(df.sparkSession)
    rows = []
    for i, x in enumerate(links):
        attrs = F.array_sort(F.array(*[F.struct(_filled(k, holes).alias("name"), _filled(v, holes).alias("value")) for k, v in x.attrs])) if x.attrs else F.expr("cast(array() as array<struct<name:string,value:string>>)")
        if x.attrs:
            attrs = F.filter(attrs, lambda e: e.value.isNotNull())
        rows.append(F.struct(F.lit(i).alias("i"), _filled(x.origin, holes).alias("origin"), _filled(x.rel, holes).alias("rel"), _filled(x.target, holes).alias("target"), F.lit(x.is_iri).alias("is_iri"), attrs.alias("attrs")))
    flat = df.select(F.explode(F.array(*rows)).alias("l")).select("l.*").where("origin is not null and rel is not null and target is not null")
    return Linkset.from_columns(flat, F.col("origin"), F.col("rel"), F.col("target"), F.col("attrs"), F.col("is_iri"), row_id)


def ingest_with(df: DataFrame, make: Callable[[dict], str | None], **options) -> Linkset:
    """The links of rows whose text a Python function writes, a row as a dict each; None gives none. In Arrow batches: for what
    no template can say."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [make({k: None if v is None else str(v) for k, v in r.items()}) for r in b.astype(object).where(b.notna(), None).to_dict("records")]
            rows = [(None, x.origin, x.rel, x.target, x.is_iri, [{"name": k, "value": v} for k, v in sorted(x.attrs)]) for t in texts if t for x in literate.parse(t, **options)[0]]
            yield pd.DataFrame(rows, columns=[f.name for f in LINK_SCHEMA.fields])

    return Linkset(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).mapInPandas(run, LINK_SCHEMA))


def read_csv(spark: SparkSession, path: str, template: str, multi_line: bool = True, **options) -> Linkset:
    """Without ``multi_line``, for files in which no value has a line break, large files are read in splits."""
    return ingest(spark.read.csv(path, header=True, multiLine=multi_line, escape='"'), template, **options)


def read_json(spark: SparkSession, path: str, template: str, multi_line: bool = True, **options) -> Linkset:
    """A file is one JSON text, or without ``multi_line`` an object a line, read in splits."""
    return ingest(spark.read.json(path, multiLine=multi_line), template, **options)


def batches(df: DataFrame, template: str, key: Column, n: int, **options) -> Iterator[Linkset]:
    """``n`` sets that together are all rows, split by a hash of ``key``. The rows are read once and written apart."""
    path = shared_dir(df.sparkSession)
    df.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).write.partitionBy("_batch").parquet(path)
    whole = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(path)
    for i in range(n):
        yield ingest(whole.where(F.col("_batch") == i).drop("_batch"), template, **options)


def to_csv_rows(links: Linkset, columns: Mapping[str, str], types: Sequence[str] | None = None, type_rel: str = TYPE, sep: str = "|") -> DataFrame:
    """One row per (typed) resource, a column per rel, several values joined."""
    return links.pivot(columns, sep, types, type_rel)


def write_csv(links: Linkset, path: str, columns: Mapping[str, str], **options) -> None:
    to_csv_rows(links, columns, **options).drop("origin").write.csv(path, header=True)
