"""The Markdown-like literate format: reading and writing."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkframe.functions.hashing import IdGen
from linkframe.functions.iri import is_reference, resolve
from linkframe.operators.linkset import Linkset
from linkframe.schema import LINK_SCHEMA, NS, NULL, TYPE

LANG = "@lang"
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass
class Link:
    origin: str
    rel: str
    target: str
    is_iri: bool
    attrs: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Value:
    text: str
    kind: str  # 'iri', 'quoted' or 'bare'


@dataclass
class State:
    base: str | None = None
    schema: str | None = None
    targets: str | None = None
    prefixes: dict[str, str] = field(default_factory=dict)
    document: str | None = None
    lang: str | None = None
    kinds: dict[str, str] = field(default_factory=dict)


def _without_comments(text: str) -> str:
    text = re.sub(r"<!--.*?-->", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    text = re.sub(r"^[ \t]*/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text, flags=re.S | re.M)
    return re.sub(r"^[ \t]*//.*$", "", text, flags=re.M)


def _value(raw: str) -> Value:
    s = raw.strip()
    m = re.match(r"<([^<>\s\"{}|\\^`]*)>\s*(?://.*|/\*.*)?$", s)
    if m:
        return Value(m[1], "iri")
    m = re.match(r"(?s)([\"'])((?:\\.|(?!\1).)*)\1\s*(?://.*|/\*.*)?$", s)
    if m:
        return Value(re.sub(r"(?s)\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[2]), "quoted")
    return Value(s, "bare")


_HEADER = re.compile(r"^(#+)[ \t]*([^\s\[\]]*)[ \t]*(?:\[([^\]]*)\])?[ \t]*$")
_PROP = re.compile(r"^([ \t]*)\*[ \t]+(<[^<>]*>|[^\s<>\"]+?)[ \t]*:(?:[ \t]+(.*)|[ \t]*)$", re.S)


def expand(ref: str | None, base: str | None, prefixes: Mapping[str, str]) -> str:
    """An identifier as it is written: nothing, ``@term``, ``@prefix/rest``, ``<iri>`` or a relative reference."""
    if ref is None or ref == "":
        return NULL
    if ref.startswith("<") and ref.endswith(">"):
        return resolve(ref[1:-1], base)
    if ref.startswith("@"):
        m = re.match(r"@([\w-]+)([/#@])(.*)$", ref)
        if m and m[1] in prefixes:
            return prefixes[m[1]] + ("" if m[2] == "@" else m[2]) + m[3]
        return NS + ref[1:]
    if not is_reference(ref):
        raise ValueError(f"not an IRI reference: {ref!r}")
    return resolve(ref, base)


def _blocks(text: str) -> Iterator[tuple[int, str, str | None, list]]:
    """(level, id, type, properties) of each header; a property is [indent, key, raw value, attributes]."""
    current: tuple | None = None
    last = None
    for line in _without_comments(text).replace("\r\n", "\n").split("\n"):
        if m := _HEADER.match(line):
            if current:
                yield current
            current, last = (len(m[1]), m[2], m[3], []), None
            continue
        if current is None:
            continue
        if m := _PROP.match(line):
            indent, props = len(m[1].expandtabs(4)), current[3]
            prop = [indent, m[2], m[3] or "", []]
            if props and indent > props[-1][0]:
                props[-1][3].append(prop)
            else:
                props.append(prop)
            last = prop
        elif line.strip() and last is not None:  # a value goes on
            last[2] += "\n" + line.strip()
        elif not line.strip() and last is not None and not re.match(r"\s*[\"']", last[2]):
            last = None
    if current:
        yield current


def _docheader(props: list, st: State, out: list[Link]) -> None:
    for _, key, raw, subs in props:
        v = _value(raw).text
        if key == "@iri":
            for _, k, r, _ in subs:
                x = _value(r).text
                if k == "@base":
                    st.base = st.targets = x
                elif k == "@schema":
                    st.schema = x
                elif k in ("@resource-type", "@property"):
                    st.targets = x
                else:
                    st.prefixes[k.lstrip("@")] = x
        elif key == "@document":
            st.document = resolve(v, st.base)
        elif key == "@language":
            st.lang = v
        elif key == "@interpretations":
            st.kinds |= {expand(k, st.schema, st.prefixes): _value(r).text.lstrip("@") for _, k, r, _ in subs}
        elif st.document is not None:
            out.append(Link(st.document, expand(key, st.schema, st.prefixes), v, _value(raw).kind == "iri"))


def parse(text: str, autotype: Mapping[int, str] | None = None, anonymous: bool = False) -> tuple[list[Link], str | None]:
    """The links of a document in order, and its ``@document`` IRI. ``autotype``: header level -> type where a header names
    none. ``anonymous``: headers without an id get generated ids instead of the NULL resource. Errors in references are
    ValueErrors; text that is no header, property or value is passed over."""
    st, out, gen = State(), [], IdGen()
    for level, rid, rtype, props in _blocks(text):
        if rid == "@docheader":
            _docheader(props, st, out)
            continue
        origin = next(gen) if anonymous and not rid else expand(rid, st.base, st.prefixes)
        rtype = rtype or (autotype or {}).get(level)
        if rtype:
            out.append(Link(origin, TYPE, expand(rtype, st.schema, st.prefixes), True))
        for _, key, raw, subs in props:
            rel, v = expand(key, st.schema, st.prefixes), _value(raw)
            attrs = [(expand(k, st.schema, st.prefixes), _value(r).text) for _, k, r, _ in subs]
            how = st.kinds.get(rel) if v.kind == "bare" else None
            if v.kind == "iri" or how == "resource":
                out.append(Link(origin, rel, resolve(v.text, st.targets), True, attrs))
            elif how == "resourceset":
                out += [Link(origin, rel, resolve(x, st.targets), True, attrs) for x in v.text.split()]
            else:
                lang = [(LANG, st.lang)] if st.lang and v.kind == "quoted" else []
                out.append(Link(origin, rel, v.text, False, attrs + lang))
    return out, st.document


def links_of(spark: SparkSession, text: str, **options) -> Linkset:
    return Linkset.of(spark, [(x.origin, x.rel, x.target, dict(x.attrs), x.is_iri) for x in parse(text, **options)[0]])


def read(spark: SparkSession, path: str, **options) -> Linkset:
    """Literate files, each parsed where it lies. The id of a link keeps its place within its file."""
    return from_texts(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("text")), **options)


def from_texts(docs: DataFrame, **options) -> Linkset:
    """From a column ``text`` of whole documents with a ``name``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(int(h) + i, x.origin, x.rel, x.target, x.is_iri, [{"name": k, "value": v} for k, v in sorted(x.attrs)]) for h, t in zip(b["h"], b["text"]) if t for i, x in enumerate(parse(t, **options)[0])]
            yield pd.DataFrame(rows, columns=[f.name for f in LINK_SCHEMA.fields])

    start = F.shiftleft(F.shiftright(F.xxhash64("name"), 25), 24)
    return Linkset(docs.select(start.alias("h"), "text").mapInPandas(run, LINK_SCHEMA))


def _quoted(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def blocks(links: Linkset, base: str | None = None, schema: str | None = None, type_rel: str = TYPE) -> DataFrame:
    """(origin, value): one block of text per origin, its links sorted; identifiers below ``base`` and ``schema`` shortened."""
    short = lambda c, b: F.when(c.startswith(b), F.substring(c, len(b) + 1, 1 << 30)).otherwise(c) if b else c
    rel = lambda c: F.when(c.startswith(NS), F.concat(F.lit("@"), F.substring(c, len(NS) + 1, 1 << 30))).when(c.startswith(schema), short(c, schema)).otherwise(F.concat(F.lit("<"), c, F.lit(">"))) if schema else F.concat(F.lit("<"), c, F.lit(">"))
    grouped = links.df.groupBy("origin").agg(
        F.min(F.when(F.col("rel") == type_rel, F.col("target"))).alias("type"),
        F.array_sort(F.collect_list(F.when(F.col("rel") != type_rel, F.struct("rel", "target", "attrs", F.coalesce("target_is_iri", F.lit(False)).alias("iri"))))).alias("links"),
        F.array_sort(F.collect_list(F.when(F.col("rel") == type_rel, F.col("target")))).alias("types"),
    )
    attrs = lambda x: F.array_join(F.transform(x.attrs, lambda e: F.concat(F.lit("    * "), short(e.getField("name"), schema), F.lit(": "), _quoted(e.getField("value")), F.lit("\n"))), "")
    line = lambda x: F.concat(F.lit("* "), rel(x.rel), F.lit(": "), F.when(x.iri, F.concat(F.lit("<"), x.target, F.lit(">"))).otherwise(_quoted(x.target)), F.lit("\n"), attrs(x))
    more = F.array_join(F.transform(F.slice("types", 2, 1 << 20), lambda t: F.concat(F.lit("* "), rel(F.lit(type_rel)), F.lit(": <"), t, F.lit(">\n"))), "")
    head = F.concat(F.lit("# "), short(F.col("origin"), base), F.coalesce(F.concat(F.lit(" ["), short(F.col("type"), schema), F.lit("]")), F.lit("")), F.lit("\n\n"))
    return grouped.select("origin", F.concat(head, more, F.array_join(F.transform("links", line), ""), F.lit("\n")).alias("value"))


def header(base: str | None = None, schema: str | None = None) -> str:
    if not base and not schema:
        return "\n\n"
    lines = ["# @docheader", "", "* @iri:"] + ([f"    * @base: {base}"] if base else []) + ([f"    * @schema: {schema}"] if schema else [])
    return "\n".join(lines) + "\n\n"


def to_text(links: Linkset, base: str | None = None, schema: str | None = None) -> str:
    """The whole set as one text, origins in order: for sets that fit the driver."""
    return header(base, schema) + "".join(r.value for r in blocks(links, base, schema).orderBy("origin").collect())


def write(links: Linkset, path: str, base: str | None = None, schema: str | None = None) -> None:
    """As text files, origins in order over all of them; a file without the header before it reads by itself only where no
    base or schema was given, so with one every file repeats the header."""
    out = blocks(links, base, schema).orderBy("origin")
    if base or schema:
        first = F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy("origin"))
        out = out.withColumn("value", F.concat(F.when(first == 1, F.lit(header(base, schema))).otherwise(F.lit("")), "value"))
    out.select("value").write.text(path, lineSep="\n")
