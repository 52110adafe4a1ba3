"""Other formats: N-Triples, JSON dump, JSON-LD, RDFS, Mermaid, embedded HTML metadata, Atom."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkframe.functions.hashing import id_of
from linkframe.functions.iri import resolve
from linkframe.operators.linkset import Linkset
from linkframe.schema import LABEL, LINK_SCHEMA, NS, PROPERTIES, RDF_TYPE, RDFS_NS, REFINES, TYPE, VALUE, cut

# --- N-Triples

NTRIPLE = r'^\s*<([^<>]*)>\s+<([^<>]*)>\s+(?:<([^<>]*)>|"((?:[^"\\]|\\.)*)")\s*\.\s*$'
BLANK = r"^\s*_:|^\s*<[^<>]*>\s+<[^<>]*>\s+_:"


def _unescaped(c: Column) -> Column:
    c = F.replace(c, F.lit("\\\\"), F.lit(""))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(c, F.lit(""), F.lit("\\"))


def _escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ntriples(lines: DataFrame, only_rel: Iterable[str] = (), exclude_rel: Iterable[str] = (), disjoint: Linkset | None = None, dedup: bool = True) -> Linkset:
    """From a column ``value`` of lines, batch or stream (without ``dedup`` and ``disjoint``). rdf:type becomes the built-in
    type, which ``only_rel`` always keeps. Lines with language or datatype are passed over; blank nodes are an error."""
    c = F.col("value")
    blank = F.when(c.rlike(BLANK), F.raise_error(F.concat(F.lit("blank node: "), c)).cast("boolean")).otherwise(c.rlike(NTRIPLE))
    rel = F.regexp_extract(c, NTRIPLE, 2)
    is_iri = F.regexp_extract(c, NTRIPLE, 3) != ""
    df = lines.where(blank).select(F.regexp_extract(c, NTRIPLE, 1).alias("o"), F.when(rel == RDF_TYPE, F.lit(TYPE)).otherwise(rel).alias("r"), F.when(is_iri, F.regexp_extract(c, NTRIPLE, 3)).otherwise(_unescaped(F.regexp_extract(c, NTRIPLE, 4))).alias("t"), is_iri.alias("i"))
    if only := list(only_rel):
        df = df.where(F.col("r").isin([*only, TYPE]))
    if excluded := list(exclude_rel):
        df = df.where(~F.col("r").isin(excluded))
    out = Linkset.from_columns(df, F.col("o"), F.col("r"), F.col("t"), None, F.col("i"))
    if disjoint is not None:
        out = out.minus(disjoint)
    return out.unique() if dedup else out


def read_ntriples(spark: SparkSession, path: str, **options) -> Linkset:
    return ntriples(spark.read.text(path), **options)


# Built-in terms and their RDF names.
RDF_NAMES = {NS + "Resource": RDFS_NS + "Class", NS + "Property": "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property", NS + "description": RDFS_NS + "comment", NS + "label": RDFS_NS + "label", NS + "type": RDF_TYPE}


def to_ntriples(links: Linkset) -> DataFrame:
    """(value): a line per link; attributes are lost, the document header is left out."""
    from linkframe.functions.text import lookup

    named = lambda c: lookup(F.col(c), RDF_NAMES, F.col(c))
    target = F.when(F.coalesce("target_is_iri", F.lit(False)), F.concat(F.lit("<"), named("target"), F.lit(">"))).otherwise(F.concat(F.lit('"'), _escaped(F.col("target")), F.lit('"')))
    return links.df.where(F.col("origin") != "@docheader").select(F.concat(F.lit("<"), "origin", F.lit("> <"), named("rel"), F.lit("> "), target, F.lit(" .")).alias("value"))


def turtle(links: Linkset) -> DataFrame:
    """(origin, value): a Turtle block per resource, its statements sorted; attributes are lost. Blocks can stand in any order."""
    from linkframe.functions.text import lookup

    named = lambda c: F.concat(F.lit("<"), lookup(F.col(c), RDF_NAMES, F.col(c)), F.lit(">"))
    target = F.when(F.coalesce("target_is_iri", F.lit(False)), named("target")).otherwise(F.concat(F.lit('"'), _escaped(F.col("target")), F.lit('"')))
    rows = links.df.where("target is not null").select("origin", F.concat(F.lit("    "), named("rel"), F.lit(" "), target).alias("line"))
    return rows.groupBy("origin").agg(F.array_join(F.array_sort(F.collect_set("line")), " ;\n").alias("lines")).select("origin", F.concat(F.lit("<"), "origin", F.lit(">\n"), "lines", F.lit(" .\n")).alias("value"))


# --- JSON dump

def to_json_lines(links: Linkset) -> DataFrame:
    """(value): ``[id, [origin, rel, target, attributes]]`` a line."""
    attrs = F.to_json(F.map_from_entries(F.transform(F.array_distinct("attrs"), lambda e: F.struct(e["name"], e["value"]))))
    parts = F.concat(F.lit("["), _json(F.col("origin")), F.lit(","), _json(F.col("rel")), F.lit(","), _json(F.col("target")), F.lit(","), attrs, F.lit("]"))
    return links.df.select(F.concat(F.lit("["), F.coalesce(F.col("link_id").cast("string"), F.lit("null")), F.lit(","), parts, F.lit("]")).alias("value"))


def _json(c: Column) -> Column:
    """A JSON string."""
    return F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""), F.lit("null"))


def load_json(text: str) -> list[tuple]:
    """Links of a dump: ``[id, link]`` or bare links of three or four parts; '@target-type' marks an IRI."""
    out = []
    for item in json.loads(text):
        link = item[1] if len(item) == 2 else item
        o, r, t, *a = link
        attrs = dict(a[0]) if a and a[0] else {}
        iri = attrs.pop("@target-type", None) == "@iri-ref"
        out.append((o, r, t, attrs, iri))
    return out


def read_json_dump(spark: SparkSession, path: str, by_line: bool = False) -> Linkset:
    """Dump files, a JSON array each or an item a line, parsed where they lie. ``by_line`` for files of an item a line, which are
    then read in splits; otherwise a file is read as one text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["value"]:
                text = text.strip()
                if not text:
                    continue
                items = json.loads(text) if text.startswith("[[") or text == "[]" else [json.loads(x) for x in text.splitlines() if x.strip()]
                for n, item in enumerate(items):
                    (o, r, t, attrs, iri), i = load_json(json.dumps([item]))[0], item[0] if len(item) == 2 else n
                    rows.append((i, o, r, t, iri or None, [{"name": k, "value": v} for k, v in sorted(attrs.items())]))
            yield pd.DataFrame(rows, columns=[f.name for f in LINK_SCHEMA.fields])

    return Linkset(spark.read.text(path, wholetext=not by_line).mapInPandas(run, LINK_SCHEMA))


# --- JSON-LD


def _objects(rows: DataFrame) -> DataFrame:
    """(origin, body, n): the members of each object as JSON text, from (origin, k, v)."""
    vals = rows.groupBy("origin", "k").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    member = F.concat(_json(F.col("k")), F.lit(":"), F.when(F.size("vs") == 1, F.get("vs", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("vs", ","), F.lit("]"))))
    return vals.groupBy("origin").agg(F.array_join(F.array_sort(F.collect_list(member)), ",").alias("body"), F.count_if(F.col("k") != "@type").alias("n"))


def jsonld(links: Linkset, vocab: str = "", ignore_types: Iterable[str] = (), type_rel: str = TYPE) -> DataFrame:
    """(origin, value): a JSON object per resource that no other one refers to. A resource it refers to is put in its place,
    one level deep; further references stay ids. Several values are a list; keys are relative to ``vocab``; resources of
    ignored types are left out, and so are objects of only an id and a type."""
    short = lambda c: F.when(c.startswith(vocab), F.substring(c, len(vocab) + 1, 1 << 30)).otherwise(c) if vocab else c
    ignored = list(ignore_types)
    df = links.df.where("target is not null").select("origin", "rel", "target").distinct()
    if ignored:
        bad = df.where((F.col("rel") == type_rel) & F.col("target").isin(ignored)).select("origin")
        df = df.join(bad, "origin", "left_anti")
    key = F.when(F.col("rel") == type_rel, F.lit("@type")).otherwise(short(F.col("rel")))

    known = df.select("origin").distinct()
    plain = df.join(known.select(F.col("origin").alias("_known")), F.col("target") == F.col("_known"), "left")
    leaf = plain.select("origin", key.alias("k"), F.when(F.col("_known").isNotNull(), F.concat(F.lit('{"@id":'), _json(F.col("target")), F.lit("}"))).otherwise(_json(F.when(F.col("rel") == type_rel, short(F.col("target"))).otherwise(F.col("target")))).alias("v"))
    inner = _objects(leaf).select(F.col("origin").alias("_at"), F.concat(F.lit('{"@id":'), _json(F.col("origin")), F.lit(","), "body", F.lit("}")).alias("nested"))
    top = df.join(df.where("target <> origin").select(F.col("target").alias("_t")).distinct(), F.col("origin") == F.col("_t"), "left_anti")
    put = top.join(inner, F.col("target") == F.col("_at"), "left")
    rows = put.select("origin", key.alias("k"), F.coalesce("nested", _json(F.when(F.col("rel") == type_rel, short(F.col("target"))).otherwise(F.col("target")))).alias("v"))
    return _objects(rows).where("n > 0").select("origin", F.concat(F.lit('{"@id":'), _json(F.col("origin")), F.lit(","), "body", F.lit("}")).alias("value"))


def jsonld_tree(links: Linkset, vocab: str = "", ignore_types: Iterable[str] = (), type_rel: str = TYPE) -> DataFrame:
    """(origin, value): like ``jsonld``, but nested to any depth, each object once: a resource that others refer to stands whole in
    the first of them (in order of ids, and there at the first of the rels), and as its id in the rest; what no other holds is
    at the top. Objects are put together from the innermost outwards, a round a level; where resources hold each other in a
    circle, the references from a later to an earlier id stay ids."""
    short = lambda c: F.when(c.startswith(vocab), F.substring(c, len(vocab) + 1, 1 << 30)).otherwise(c) if vocab else c
    df = links.df.where("target is not null").select("origin", "rel", "target").distinct()
    if ignored := list(ignore_types):
        df = df.join(df.where((F.col("rel") == type_rel) & F.col("target").isin(ignored)).select("origin"), "origin", "left_anti")
    df = cut(df)
    known = df.select(F.col("origin").alias("_known")).distinct()
    refs = df.where((F.col("rel") != type_rel) & (F.col("target") != F.col("origin"))).join(known, F.col("target") == F.col("_known"), "left_semi")
    held = cut(refs.groupBy(F.col("target").alias("child")).agg(F.min(F.struct("origin", "rel")).alias("m")).select("child", F.col("m.origin").alias("holder"), F.col("m.rel").alias("at")))
    value = F.when(F.col("rel") == type_rel, _json(short(F.col("target")))).when(F.col("_known").isNotNull(), F.concat(F.lit('{"@id":'), _json(F.col("target")), F.lit("}"))).otherwise(_json(F.col("target")))
    key = F.when(F.col("rel") == type_rel, F.lit("@type")).otherwise(short(F.col("rel")))
    flat = cut(df.join(known, F.col("target") == F.col("_known"), "left").select("origin", "rel", "target", key.alias("k"), value.alias("v")))
    left, done = cut(known.select(F.col("_known").alias("origin"))), None
    while True:
        waits = held.join(left.select(F.col("origin").alias("child")), "child", "left_semi").select(F.col("holder").alias("origin"))
        ready = cut(left.join(waits, "origin", "left_anti"))
        if not ready.limit(1).count():
            if not left.limit(1).count():
                break
            circle = held.join(left.select(F.col("origin").alias("child")), "child", "left_semi").where("child < holder").select("child")
            held = cut(held.join(circle, "child", "left_anti"))
            continue
        rows = flat.join(ready, "origin", "left_semi")
        if done is not None:
            inner = held.join(done, F.col("child") == F.col("origin")).select(F.col("holder").alias("_h"), F.col("at").alias("_r"), F.col("child").alias("_c"), "value")
            rows = rows.join(inner, (F.col("origin") == F.col("_h")) & (F.col("rel") == F.col("_r")) & (F.col("target") == F.col("_c")), "left").select("origin", "k", F.coalesce("value", "v").alias("v"))
        new = cut(_objects(rows.select("origin", "k", "v")).select("origin", F.concat(F.lit('{"@id":'), _json(F.col("origin")), F.lit(","), "body", F.lit("}")).alias("value"), "n"))
        done = new if done is None else done.unionByName(new)
        left = cut(left.join(ready, "origin", "left_anti"))
    if done is None:
        return links.df.limit(0).select("origin", F.lit("").alias("value"))
    return done.join(held.select(F.col("child").alias("origin")), "origin", "left_anti").where("n > 0").drop("n")


def unwrapped(objects: DataFrame, column: str = "value") -> DataFrame:
    """JSON-LD whose ``{"@value": x}`` are plain ``x``."""

    def plain(x):
        if isinstance(x, dict):
            return plain(x["@value"]) if "@value" in x else {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else json.dumps(plain(json.loads(t)), ensure_ascii=False))

    return objects.withColumn(column, F.pandas_udf(run, "string")(column))


# --- RDFS


def rdfs(links: Linkset, only_below: str | None = None) -> Linkset:
    """A vocabulary in RDFS terms: refines becomes subClassOf or subPropertyOf by the type of its origin, properties become
    domains the other way round, values ranges (of resources), labels and descriptions labels and comments."""
    df = links.df if only_below is None else links.df.where(F.col("origin").startswith(only_below))
    kinds = links.df.where(F.col("rel") == TYPE).groupBy("origin").agg(F.max(F.col("target") == NS + "Property").alias("_prop")).withColumnRenamed("origin", "_o")
    df = df.join(kinds, F.col("origin") == F.col("_o"), "left")
    rel, is_prop = F.col("rel"), F.coalesce("_prop", F.lit(False))
    swap = rel == PROPERTIES
    out_rel = (
        F.when(rel == REFINES, F.when(is_prop, F.lit(RDFS_NS + "subPropertyOf")).otherwise(F.lit(RDFS_NS + "subClassOf"))).when(swap, F.lit(RDFS_NS + "domain")).when(rel == VALUE, F.lit(RDFS_NS + "range"))
        .when(rel == LABEL, F.lit(RDFS_NS + "label")).when(rel == NS + "description", F.lit(RDFS_NS + "comment")).when(rel == TYPE, F.lit(RDF_TYPE))
    )
    t = F.col("target")
    named = F.when((rel == TYPE) & (t == NS + "Property"), F.lit(RDF_NAMES[NS + "Property"])).when((rel == TYPE) & (t == NS + "Resource"), F.lit(RDFS_NS + "Class")).otherwise(t)
    is_iri = out_rel.isin(RDFS_NS + "subPropertyOf", RDFS_NS + "subClassOf", RDFS_NS + "domain", RDFS_NS + "range", RDF_TYPE)
    kept = df.withColumns({"_rel": out_rel, "_t": F.when(swap, F.col("origin")).otherwise(named), "_i": is_iri, "_from": F.when(swap, t).otherwise(F.col("origin"))}).where("_rel is not null").where(~((rel == VALUE) & t.isin(NS + "Literal", NS + "IRI", "Literal", "IRI")))
    return Linkset.from_columns(kept, F.col("_from"), F.col("_rel"), F.col("_t"), None, F.col("_i"))


# --- Mermaid


def mermaid(links: Linkset, label_rel: str = LABEL) -> DataFrame:
    """(value): an edge of a ``graph TD`` per link. A node's tag is the end of its IRI, shortened in the middle; tags that
    several nodes would share are numbered. Labelled resources show their label."""
    df = links.df.where("target is not null")
    is_iri = F.coalesce("target_is_iri", F.lit(False))
    tag = lambda c: F.regexp_replace(F.element_at(F.split(F.regexp_replace(c, r"[/#]+$", ""), "[/#]"), -1), r"\W", "_")
    short = lambda c: F.when(F.length(c) > 15, F.concat(F.substring(c, 1, 6), F.lit("..."), F.substring(c, -6, 6))).otherwise(c)
    nodes = df.select(F.col("origin").alias("node"), F.lit(True).alias("iri")).unionByName(df.select(F.col("target").alias("node"), is_iri.alias("iri"))).distinct()
    base = F.replace(short(tag(F.col("node"))), F.lit("..."), F.lit("_"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy("node", "iri"))
    nodes = nodes.withColumn("tag", base).withColumn("rank", rank)
    nodes = nodes.withColumn("tag", F.when(F.col("rank") == 1, F.col("tag")).otherwise(F.concat("tag", F.lit("_"), (F.col("rank") - 1).cast("string"))))
    labels = df.where(F.col("rel") == label_rel).groupBy(F.col("origin").alias("node")).agg(F.min("target").alias("label"))
    shown = nodes.join(labels, "node", "left")
    text = F.when(~F.col("iri"), F.concat("tag", F.lit('["'), F.replace(F.col("node"), F.lit('"'), F.lit("'")), F.lit('"]'))).when(F.col("label").isNotNull(), F.concat("tag", F.lit("(fa:fa-tag "), "label", F.lit(")"))).otherwise(F.concat("tag", F.lit("("), short(tag(F.col("node"))), F.lit(")")))
    shown = shown.select("node", "iri", text.alias("text"))
    a = shown.where("iri").select(F.col("node").alias("_a"), F.col("text").alias("_at"))
    b = shown.select(F.col("node").alias("_b"), F.col("iri").alias("_bi"), F.col("text").alias("_bt"))
    edges = df.join(a, F.col("origin") == F.col("_a")).join(b, (F.col("target") == F.col("_b")) & (is_iri == F.col("_bi")))
    return edges.select(F.concat(F.lit("    "), "_at", F.lit(" -->|"), short(tag(F.col("rel"))), F.lit("| "), "_bt").alias("value"))


# --- embedded HTML metadata (RDFa Lite) and plain hyperlinks

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Prefixes that need no declaration.
PREFIXES = {"schema": "http://schema.org/", "dc": "http://purl.org/dc/terms/", "foaf": "http://xmlns.com/foaf/0.1/", "og": "http://ogp.me/ns#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": RDFS_NS}


class _Rdfa(HTMLParser):
    """Walks the tags with a stack of (resource, vocabulary, prefixes); a property whose value is its text waits for the end."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.links = base, []
        self.stack: list[tuple] = [("", base, "", PREFIXES, None)]
        self.blank = 0

    def term(self, t: str, vocab: str, prefixes: Mapping[str, str]) -> str:
        p, colon, rest = t.partition(":")
        if colon and p in prefixes:
            return prefixes[p] + rest
        return t if "://" in t else vocab + t

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        _, subject, vocab, prefixes, _ = self.stack[-1]
        vocab = a.get("vocab", vocab)
        if "prefix" in a:
            w = a["prefix"].split()
            prefixes = {**prefixes, **{k.rstrip(":"): v for k, v in zip(w[::2], w[1::2])}}
        props = [self.term(p, vocab, prefixes) for p in a.get("property", "").split()]
        types = [self.term(t, vocab, prefixes) for t in a.get("typeof", "").split()]
        new, wait = subject, None
        if "resource" in a or types:
            if "resource" in a:
                new = resolve(a["resource"], self.base)
            elif props and ("href" in a or "src" in a):
                new = resolve(a.get("href", a.get("src")), self.base)
            else:
                self.blank += 1
                new = "_:" + id_of(f"{self.base} {self.blank}")
            self.links += [(subject, p, new, True) for p in props]
            self.links += [(new, TYPE, t, True) for t in types]
        elif props:
            if "content" in a:
                self.links += [(subject, p, a["content"], False) for p in props]
            elif "href" in a or "src" in a:
                self.links += [(subject, p, resolve(a.get("href", a.get("src")), self.base), True) for p in props]
            else:
                wait = (subject, props, [])
        if tag in _VOID:
            if wait:
                self.links += [(s, p, "", False) for s, ps, _ in [wait] for p in ps]
        else:
            self.stack.append((tag, new, vocab, prefixes, wait))

    def handle_data(self, data):
        for *_, wait in self.stack:
            if wait:
                wait[2].append(data)

    def handle_endtag(self, tag):
        if not any(t == tag for t, *_ in self.stack):
            return
        while self.stack:
            t, *_, wait = self.stack.pop()
            if wait:
                self.links += [(wait[0], p, "".join(wait[2]), False) for p in wait[1]]
            if t == tag:
                return

    def close(self):
        super().close()
        while len(self.stack) > 1:
            self.handle_endtag(self.stack[-1][0])


class _Hrefs(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.links = base, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href"):
            self.links.append((self.base, NS + "href", resolve(a["href"], self.base), True))


def html_links(pages: DataFrame, url: str = "url", html: str = "html", metadata: bool = True) -> Linkset:
    """Links of HTML pages: their RDFa Lite statements, or with ``metadata`` False their hyperlinks. Null pages have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u, h in zip(b["u"], b["h"]):
                if u and h:
                    p = (_Rdfa if metadata else _Hrefs)(u)
                    p.feed(h)
                    p.close()
                    rows += [(i, o, r, t, iri, []) for i, (o, r, t, iri) in enumerate(p.links)]
            yield pd.DataFrame(rows, columns=[f.name for f in LINK_SCHEMA.fields])

    return Linkset(pages.select(F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(run, LINK_SCHEMA))


# --- Atom

ATOM = "{http://www.w3.org/2005/Atom}"


def atom(feeds: DataFrame, column: str = "value", vocab: str = "http://www.w3.org/2005/Atom#") -> Linkset:
    """Entries of Atom feeds (whole texts): type, title, updated, author names, links, categories, summary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["x"]:
                if not text:
                    continue
                for e in ElementTree.fromstring(text).iter(ATOM + "entry"):
                    get = lambda n, e=e: (e.findtext(ATOM + n) or "").strip()
                    rid = get("id") or next((x.get("href", "") for x in e.iter(ATOM + "link")), "")
                    if not rid:
                        continue
                    found = [(TYPE, vocab + "entry", True)] + [(vocab + n, get(n), False) for n in ("title", "updated", "published", "summary", "content") if get(n)]
                    found += [(vocab + "author", a.findtext(ATOM + "name").strip(), False) for a in e.iter(ATOM + "author") if a.findtext(ATOM + "name")]
                    found += [(vocab + (x.get("rel") or "link"), x.get("href"), True) for x in e.iter(ATOM + "link") if x.get("href")]
                    found += [(vocab + "category", x.get("term"), False) for x in e.iter(ATOM + "category") if x.get("term")]
                    rows += [(i, rid, r, t, iri, []) for i, (r, t, iri) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[f.name for f in LINK_SCHEMA.fields])

    return Linkset(feeds.select(F.col(column).alias("x")).mapInPandas(run, LINK_SCHEMA))
