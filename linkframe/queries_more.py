"""Further queries over links: storage, formats, rules and their actions, streams, the command line. Each over whole tables,
with the SQL it is held against; they stand in the registry of ``queries_links``."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linkframe import cli
from linkframe.functions.hashing import IdGen, hash_id
from linkframe.functions.iri import resolve_col
from linkframe.functions.text import numeric_guard
from linkframe.operators.graph import zoom
from linkframe.operators.linkset import Linkset, attrs_column
from linkframe.plans.mapping import rel, resource, rows_as_links
from linkframe.plans.pipeline import (
    Definition, Pipeline, action_template, attr, column_action, compose, extra, follow, foreach, if_, ifexists, ignore, link, lookup, materialize, origin, regex_match_modify, relation_action, replace_from, rel as rel_, run_actions, stage,
    target, toiri, udf_action, values, var,
)
from linkframe.queries_links import V, _people, links, lot, query
from linkframe.schema import LABEL, RDF_NS, TYPE, shared_dir, table
from linkframe.sources import formats, literate, sqlite, storage, templates
from linkframe.streaming import read_links, read_ntriples, run_pipeline, sessions, to_completion, unseen

_CUSTOMERS = "SELECT 'tpch:customer/' || c_custkey AS origin, 'tpch:vocab/c_name' AS rel, c_name AS target FROM customer"
_NATIONS = "SELECT 'tpch:nation/' || n_nationkey AS origin, 'tpch:vocab/n_name' AS rel, n_name AS target FROM nation"


def _nations(spark, d) -> Linkset:
    return rows_as_links(table(spark, d, "nation"), "nation", "n_nationkey", ["n_name"], {"n_regionkey": "region"})


def _customers(spark, d) -> Linkset:
    """A link a customer, with the segment as an attribute."""
    c = table(spark, d, "customer")
    return Linkset.from_columns(c, resource("customer", F.col("c_custkey")), F.lit(rel("c_name")), F.col("c_name"), attrs_column({"seg": F.col("c_mktsegment")}), F.lit(False), F.col("c_custkey"))


# --- sets and ids


@query("SELECT DISTINCT origin, rel, target FROM relationship")
def empty_and_copied(spark, d):
    ls = links(spark, d)
    return lot(Linkset.empty(spark).union(ls.copy(contents=False), ls.copy()))


@query("SELECT origin, rel, target FROM relationship ORDER BY rawid LIMIT 1 OFFSET 100")
def positional_fetch(spark, d):
    return links(spark, d).numbered().at(100).select("origin", "rel", "target")


_LABELS = "SELECT iri AS origin, 'label' AS rel, label AS target FROM authority WHERE label IS NOT NULL"


def _authority(spark, d) -> Linkset:
    a = table(spark, d, "authority").where("label is not null")
    return Linkset.from_columns(a, F.col("iri"), F.lit("label"), F.col("label"))


@query(f"""SELECT row_number() OVER (ORDER BY rawid) - 1 AS link_id, origin, rel, target FROM relationship
    UNION ALL SELECT row_number() OVER (ORDER BY origin) - 1 + (SELECT count(*) FROM relationship), origin, rel, target FROM ({_LABELS})""")
def add_after(spark, d):
    return links(spark, d).numbered().add(_authority(spark, d)).df.select("link_id", "origin", "rel", "target")


@query(f"""WITH r AS (SELECT row_number() OVER (ORDER BY rawid) - 1 AS i, origin, rel, target FROM relationship), a AS ({_LABELS})
    SELECT CASE WHEN i >= 10 THEN i + (SELECT count(*) FROM a) ELSE i END AS link_id, origin, rel, target FROM r UNION ALL SELECT row_number() OVER (ORDER BY origin) + 9, origin, rel, target FROM a""")
def add_at_position(spark, d):
    return links(spark, d).numbered().add(_authority(spark, d), index=10).df.select("link_id", "origin", "rel", "target")


@query("SELECT count(*) AS n_links, count(DISTINCT (origin, rel, target)) AS n_hashes FROM relationship")
def link_hashes(spark, d):
    return links(spark, d).hashed().agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("link_hash").alias("n_hashes"))


@query("SELECT book_id::VARCHAR AS origin, author AS target FROM books WHERE author IS NOT NULL")
def null_parts_suppressed(spark, d):
    return Linkset.from_columns(table(spark, d, "books"), F.col("book_id"), F.lit("author"), F.col("author")).complete().df.select("origin", "target")


@query(f"""WITH w AS (SELECT DISTINCT rawid FROM attribute)
    SELECT rel, target, count(*) AS n FROM (SELECT rel, target FROM relationship
      UNION ALL SELECT '{RDF_NS}subject', origin FROM relationship JOIN w USING (rawid) UNION ALL SELECT '{RDF_NS}predicate', rel FROM relationship JOIN w USING (rawid)
      UNION ALL SELECT '{RDF_NS}object', target FROM relationship JOIN w USING (rawid) UNION ALL SELECT name, value FROM attribute JOIN relationship USING (rawid)) GROUP BY ALL""")
def reified_links(spark, d):
    return links(spark, d, True).reified().df.groupBy("rel", "target").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT target AS broader, string_agg(DISTINCT origin, '|' ORDER BY origin) AS narrower FROM relationship WHERE rel = '{V}partOf' GROUP BY target")
def refinements_grouped(spark, d):
    return links(spark, d).refinements(V + "partOf").select("broader", F.array_join("narrower", "|").alias("narrower"))


@query("""SELECT 'tpch:customer/' || c_custkey AS origin, n AS name, v AS value FROM (SELECT c_custkey, unnest(['balance', 'nation', 'segment']) AS n, unnest([c_acctbal::VARCHAR, c_nationkey::VARCHAR, c_mktsegment]) AS v FROM customer) WHERE n <> 'balance'""")
def attributes_of_columns(spark, d):
    c = table(spark, d, "customer")
    attrs = attrs_column({"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey"), "none": F.lit(None)})
    return Linkset.from_columns(c, resource("customer", F.col("c_custkey")), F.lit("is"), F.col("c_name"), attrs).flatten().select("origin", "name", "value")


@query("""WITH f AS (SELECT DISTINCT origin AS n FROM relationship WHERE rel = '{V}partOf') SELECT origin, rel, target FROM relationship WHERE origin IN (SELECT n FROM f) ORDER BY rawid LIMIT 100""")
def zoom_nearest_links(spark, d):
    ls = links(spark, d)
    return lot(zoom(ls, ls.match(None, V + "partOf").df.select("origin"), 1, max_links=100)[0])


# --- storage


@query("SELECT origin, rel, target FROM relationship WHERE origin = '{MAIN}'")
def bucketed_lookup(spark, d):
    """A table bucketed by origin; of a lookup only one bucket is read."""
    name = f"links_{uuid.uuid4().hex}"
    storage.save_table(links(spark, d), name, 8, path=shared_dir(spark))
    return lot(Linkset(spark.table(name)).match("http://shelf.example/catalogue/main"))


@query("SELECT false AS there")
def dropped_table(spark, d):
    name = f"links_{uuid.uuid4().hex}"
    storage.save_table(_nations(spark, d), name, 2, path=shared_dir(spark))
    storage.drop_table(spark, name)
    return spark.createDataFrame([(spark.catalog.tableExists(name),)], "there boolean")


def _database(spark, ls: Linkset, attribute: str = "name VARCHAR(500)") -> tuple[str, dict]:
    """An embedded database that only this process has, for a local master; other databases are reached by their URLs. It compares
    texts of bounded length only, and takes nulls only in the others."""
    url, props = f"jdbc:derby:memory:l{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    storage.write_jdbc(ls, url, "x", props, "overwrite", ("origin VARCHAR(2000), rel VARCHAR(500)", attribute))
    return url, props


@query("SELECT r.origin, r.rel, r.target, a.name, a.value FROM relationship r LEFT JOIN attribute a ON a.rawid = r.rawid")
def database_round_trip(spark, d):
    sqlite.write(links(spark, d, True), path := shared_dir(spark))
    return sqlite.read(spark, path).flatten()


@query("SELECT origin, target FROM relationship r WHERE rel = '{V}label' AND EXISTS (SELECT 1 FROM attribute a WHERE a.rawid = r.rawid AND name = '@lang' AND value = 'en')")
def database_match(spark, d):
    """All links are stored with all attributes; the databases select the wanted ones."""
    sqlite.write(links(spark, d, True), path := shared_dir(spark))
    return sqlite.read(spark, path, rel=V + "label", attrs={"@lang": "en"}).df.select("origin", "target")


# --- texts


@query("SELECT * FROM (VALUES ('', 'AAAAAAAAAAA'), ('The quick brown fox jumps over the lazy dog', '40u8e7wHG2w'), ('spam', '6Xs8ixJOnDk'), ('eggs', 'jdOka-AdAMU'), ('0', 'KsnevtVGo4A'), ('1', 'cfu7_op7fHE')) t(text, id)")
def listed_ids(spark, d):
    """Ids of texts that must be exactly these."""
    df = spark.createDataFrame([("",), ("The quick brown fox jumps over the lazy dog",), ("spam",), ("eggs",), ("0",), ("1",)], "text string")
    return df.select("text", hash_id(F.col("text")).alias("id"))


@query("SELECT * FROM (VALUES (0, 'http://x/KsnevtVGo4A'), (1, 'http://x/cfu7_op7fHE'), (2, 'http://x/6Xs8ixJOnDk')) t(n, id)")
def generated_ids(spark, d):
    g = IdGen("http://x/")
    return spark.createDataFrame([(0, next(g)), (1, next(g)), (2, g.send("spam"))], "n int, id string")


@query("SELECT p_partkey, 'http://x/a/' || replace(p_type, ' ', '%20') AS iri FROM part")
def resolved_references(spark, d):
    return table(spark, d, "part").select("p_partkey", resolve_col(F.col("p_type"), "http://x/a/b").alias("iri"))


@query("SELECT p_partkey, '_' || p_size AS rel FROM part UNION ALL SELECT p_partkey, p_brand FROM part")
def guarded_numbers(spark, d):
    p = table(spark, d, "part")
    both = p.select("p_partkey", F.explode(F.array(F.col("p_size").cast("string"), "p_brand")).alias("r"))
    return both.select("p_partkey", numeric_guard(F.col("r")).alias("rel"))


# --- formats

_SHEET = r"""<!-- made
by hand -->
# @docheader

* @iri:
    * @base: http://n.example/
    * @schema: http://v.example/
    * x: http://x.example
* @document: <sheet>
* @language: en
* @interpretations:
    * within: @resource
    * keys: @resourceset
* title: a nation

## n%1$s

* name: "%2$s"
// * hidden: x
* within: r%3$s
* keys: a%1$s b%1$s
* @x/raw: %2$s

## [Nameless]

* part: of %1$s
"""


@query("""SELECT * FROM (SELECT 'http://n.example/sheet' AS origin, 'http://v.example/title' AS rel, 'a nation' AS target, NULL AS lang FROM nation
    UNION ALL SELECT 'http://n.example/n' || n_nationkey, '{TYPE}', 'http://v.example/Nation', NULL FROM nation UNION ALL SELECT 'http://n.example/n' || n_nationkey, 'http://v.example/name', n_name, 'en' FROM nation
    UNION ALL SELECT 'http://n.example/n' || n_nationkey, 'http://v.example/within', 'http://n.example/r' || n_regionkey, NULL FROM nation
    UNION ALL SELECT 'http://n.example/n' || n_nationkey, 'http://v.example/keys', 'http://n.example/' || k || n_nationkey, NULL FROM nation, (VALUES ('a'), ('b')) t(k)
    UNION ALL SELECT 'http://n.example/n' || n_nationkey, 'http://x.example/raw', n_name, NULL FROM nation
    UNION ALL SELECT 'KsnevtVGo4A', '{TYPE}', 'http://v.example/Nameless', NULL FROM nation UNION ALL SELECT 'KsnevtVGo4A', 'http://v.example/part', 'of ' || n_nationkey, NULL FROM nation)""")
def literate_documents(spark, d):
    """Headers, prefixes, interpretations, types by level, generated ids, comments: a document a nation."""
    text = F.format_string(_SHEET, F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("n_regionkey").cast("string"))
    docs = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("name"), text.alias("text"))
    m = literate.from_texts(docs, autotype={2: "Nation"}, anonymous=True)
    return m.df.select("origin", "rel", "target", F.get(F.filter("attrs", lambda a: a["name"] == "@lang"), F.lit(0))["value"].alias("lang"))


_SHEET_OF = "# tpch:customer/{c_custkey}\n\n* <tpch:vocab/c_name>: {c_name}\n"


@query(_CUSTOMERS)
def csv_text_ingest(spark, d):
    path = shared_dir(spark)
    table(spark, d, "customer").write.option("header", True).option("escape", '"').csv(path)
    return lot(templates.read_csv(spark, path, _SHEET_OF, multi_line=False))


@query(_CUSTOMERS)
def csv_in_batches(spark, d):
    first, *rest = templates.batches(table(spark, d, "customer"), _SHEET_OF, F.col("c_custkey"), 3)
    return lot(first.union(*rest, dedup=False))


@query(_NATIONS + " UNION ALL SELECT 'tpch:nation/' || n_nationkey, 'region', 'tpch:region/' || n_regionkey FROM nation")
def json_objects_ingest(spark, d):
    path = shared_dir(spark)
    table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("text"), F.col("n_regionkey").alias("of")).alias("about")).write.json(path)
    return lot(templates.read_json(spark, path, "# tpch:nation/{{ key }}\n\n* <tpch:vocab/n_name>: {{ about.text }}\n* <region>: <tpch:region/{{ about.of }}>\n", multi_line=False))


@query("SELECT origin, 'twice' || n AS rel, target FROM (" + _CUSTOMERS + " WHERE c_nationkey < 20), (VALUES (0), (1)) t(n)")
def template_rows_changed(spark, d):
    """Rows taken out and multiplied before the template sees them, and counted as they pass."""
    twice = lambda df: df.where("c_nationkey < 20").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    return lot(templates.ingest(table(spark, d, "customer"), _SHEET_OF.replace("tpch:vocab/c_name", "twice{n}"), prerow=twice, tap=Observation(uuid.uuid4().hex)))


@query("SELECT 'n' || n_nationkey AS origin, CASE WHEN n_regionkey = 1 THEN 'one' ELSE 'other' END AS rel, n_name AS target FROM nation WHERE n_regionkey <> 2")
def template_written_by_function(spark, d):
    def make(row):
        return None if row["n_regionkey"] == "2" else f"# <n{row['n_nationkey']}>\n\n* <{'one' if row['n_regionkey'] == '1' else 'other'}>: \"{row['n_name']}\"\n"

    return lot(templates.ingest_with(table(spark, d, "nation"), make))


_LINES = """SELECT '<tpch:nation/' || n_nationkey || '> <tpch:vocab/n_name> "' || n_name || '" .' AS value FROM nation UNION ALL SELECT '<tpch:nation/' || n_nationkey || '> <tpch:vocab/n_regionkey> <tpch:region/' || n_regionkey || '> .' FROM nation
    UNION ALL SELECT '<tpch:nation/' || n_nationkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <tpch:vocab/nation> .' FROM nation"""


@query(_LINES)
def ntriples_lines(spark, d):
    return formats.to_ntriples(_nations(spark, d))


@query(_NATIONS + " UNION ALL SELECT 'tpch:nation/' || n_nationkey, '{TYPE}', 'tpch:vocab/nation' FROM nation")
def ntriples_stream(spark, d):
    src, out = shared_dir(spark), shared_dir(spark)
    formats.to_ntriples(_nations(spark, d)).write.text(src)
    return to_completion(lot(read_ntriples(spark, src, only_rel=[rel("n_name")])), f"{out}/rows", f"{out}/log")


@query("""SELECT '<tpch:nation/' || n_nationkey || E'>\\n    <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <tpch:vocab/nation> ;\\n    <tpch:vocab/n_name> "' || n_name || E'" ;\\n    <tpch:vocab/n_regionkey> <tpch:region/' || n_regionkey || E'> .\\n' AS value FROM nation""")
def turtle_blocks(spark, d):
    return formats.turtle(_nations(spark, d)).select("value")


_PAGE = '<body vocab="http://s.example/" prefix="x: http://x.example/"><div resource="#n%1$s" typeof="Nation x:Place"><span property="name">The <b>%2$s</b></span><a property="x:in" href="/r/%3$s">r</a><meta property="code" content="%1$s"></div><a href="%1$s.html">more</a></body>'


def _pages(spark, d) -> DataFrame:
    html = F.format_string(_PAGE, F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("n_regionkey").cast("string"))
    return table(spark, d, "nation").select(F.lit("http://p.example/list/").alias("url"), html.alias("html"))


@query("""SELECT 'http://p.example/list/#n' || n_nationkey AS origin, rel, target FROM (SELECT n_nationkey, unnest(['{TYPE}', '{TYPE}', 'http://s.example/name', 'http://x.example/in', 'http://s.example/code']) AS rel,
    unnest(['http://s.example/Nation', 'http://x.example/Place', 'The ' || n_name, 'http://p.example/r/' || n_regionkey, n_nationkey::VARCHAR]) AS target FROM nation)""")
def html_statements(spark, d):
    return lot(formats.html_links(_pages(spark, d)))


@query("SELECT 'http://p.example/list/' AS origin, 'http://p.example/r/' || n_regionkey AS target FROM nation UNION ALL SELECT 'http://p.example/list/', 'http://p.example/list/' || n_nationkey || '.html' FROM nation")
def html_hyperlinks(spark, d):
    return formats.html_links(_pages(spark, d), metadata=False).df.select("origin", "target")


@query("""SELECT n_nationkey, '{"a": "' || n_name || '", "b": [' || n_regionkey || ', {"c": "' || n_name || '"}]}' AS value FROM nation""")
def jsonld_values_unwrapped(spark, d):
    wrapped = F.format_string('{"a": {"@value": "%1$s"}, "b": [{"@value": %2$s, "@type": "n"}, {"c": {"@value": "%1$s"}}]}', F.col("n_name"), F.col("n_regionkey").cast("string"))
    return formats.unwrapped(table(spark, d, "nation").select("n_nationkey", wrapped.alias("value")))


_FEED = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>n%1$s</id><title>%2$s</title><author><name>r%3$s</name></author><link rel="up" href="http://r/%3$s"/><link href="http://n/%1$s"/><category term="nation"/></entry><entry/></feed>'


@query("""SELECT 'n' || n_nationkey AS origin, rel, target FROM (SELECT n_nationkey, unnest(['{TYPE}', 'http://www.w3.org/2005/Atom#title', 'http://www.w3.org/2005/Atom#author', 'http://www.w3.org/2005/Atom#up', 'http://www.w3.org/2005/Atom#link',
    'http://www.w3.org/2005/Atom#category']) AS rel, unnest(['http://www.w3.org/2005/Atom#entry', n_name, 'r' || n_regionkey, 'http://r/' || n_regionkey, 'http://n/' || n_nationkey, 'nation']) AS target FROM nation)""")
def atom_entries(spark, d):
    feed = F.format_string(_FEED, F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("n_regionkey").cast("string"))
    return lot(formats.atom(table(spark, d, "nation").select(feed.alias("value"))))


@query("""WITH nh AS (SELECT c_nationkey AS k, min('tpch:customer/' || c_custkey) AS h FROM customer GROUP BY 1), rh AS (SELECT n_regionkey AS k, min('tpch:nation/' || n_nationkey) AS h FROM nation GROUP BY 1),
    n AS (SELECT n_nationkey AS k, '{"@id":"tpch:nation/' || n_nationkey || '","@type":"nation","n_name":"' || n_name || '","n_regionkey":' || CASE WHEN rh.h = 'tpch:nation/' || n_nationkey
        THEN '{"@id":"tpch:region/' || r_regionkey || '","@type":"region","r_name":"' || r_name || '"}' ELSE '{"@id":"tpch:region/' || r_regionkey || '"}' END || '}' AS j FROM nation JOIN region ON r_regionkey = n_regionkey JOIN rh ON rh.k = n_regionkey)
    SELECT 'tpch:customer/' || c_custkey AS origin, '{"@id":"tpch:customer/' || c_custkey || '","@type":"customer","c_name":"' || c_name || '","c_nationkey":' || CASE WHEN nh.h = 'tpch:customer/' || c_custkey THEN n.j ELSE '{"@id":"tpch:nation/' || c_nationkey || '"}' END || '}' AS value
      FROM customer JOIN nh ON nh.k = c_nationkey JOIN n ON n.k = c_nationkey
    UNION ALL SELECT 'tpch:nation/' || k, j FROM n WHERE k NOT IN (SELECT c_nationkey FROM customer)
    UNION ALL SELECT 'tpch:region/' || r_regionkey, '{"@id":"tpch:region/' || r_regionkey || '","@type":"region","r_name":"' || r_name || '"}' FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)""")
def jsonld_whole_trees(spark, d):
    m = _nations(spark, d).union(rows_as_links(table(spark, d, "customer"), "customer", "c_custkey", ["c_name"], {"c_nationkey": "nation"}), rows_as_links(table(spark, d, "region"), "region", "r_regionkey", ["r_name"]), dedup=False)
    return formats.jsonld_tree(m, rel(""))


# --- actions of rules, each over every customer


def _acted(spark, d, action, extras=None, base=None, whole=False) -> DataFrame:
    m = _customers(spark, d)
    made = run_actions([(m.df.withColumn("in_rid", F.col("origin")), action if whole else link(rel="out", target=action))], m, base, extras)
    return lot(made) if whole else made.df.select("origin", "target")


def _each(target_sql: str) -> str:
    return f"SELECT 'tpch:customer/' || c_custkey AS origin, {target_sql} AS target FROM customer"


@query(_each("'from extras'") + " UNION ALL " + _each("'default'"))
def action_extra(spark, d):
    return _acted(spark, d, values(extra("a"), extra("b", "default")), {"a": "from extras"})


@query(_each("c_mktsegment"))
def action_attr(spark, d):
    return _acted(spark, d, attr("seg"))


@query("SELECT count(*) AS n, count(DISTINCT c_name) AS n_ids FROM customer")
def action_computed_origin(spark, d):
    return _acted(spark, d, origin(fprint=[(TYPE, "T"), ("n", target())])).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("n_ids"))


@query(_each("'tpch:vocab/c_name'") + " UNION ALL " + _each("'tpch:customer/' || c_custkey") + " UNION ALL " + _each("c_name") + " UNION ALL " + _each("'a'") + " UNION ALL " + _each("'b'"))
def action_values(spark, d):
    return _acted(spark, d, values(rel_(), origin(), target(), ["a", "b"]))


@query(_each("CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE 'other' END"))
def action_lookup(spark, d):
    return _acted(spark, d, lookup("short", key=attr("seg"), onmiss="other"), {"short": {"BUILDING": "B", "MACHINERY": "M"}})


@query(_each("c_mktsegment") + " UNION ALL " + _each("'none'"))
def action_ifexists(spark, d):
    return _acted(spark, d, values(ifexists(attr("seg"), attr("seg"), "no"), ifexists(attr("nothing"), "yes", "none")))


@query(_each("CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END"))
def action_condition_as_sql(spark, d):
    return _acted(spark, d, if_("cast(split(origin, '/')[1] as int) % 2 = 0", "even", "odd"))


@query(_each("c_custkey::VARCHAR") + " UNION ALL " + _each("c_custkey % 10 || 'x'"))
def action_regex(spark, d):
    whole = regex_match_modify(r"\D*0*(\d+)")
    return _acted(spark, d, values(whole, regex_match_modify(r"\D*\d*(\d)$", lambda g: F.concat(g(1), F.lit("x")))))


@query(_each("replace(c_name, 'Customer', 'Client')"))
def action_replace(spark, d):
    return _acted(spark, d, replace_from([("X", "Y"), ("Customer", "Client")]))


@query(_each("upper(c_name) || '!'"))
def action_compose(spark, d):
    return _acted(spark, d, compose(column_action(lambda c: F.concat(c, F.lit("!"))), column_action(F.upper)))


@query(_each("c_name"))
def action_ignore(spark, d):
    return _acted(spark, d, values(ignore(), target()))


@query(_each("reverse(c_name)") + " UNION ALL " + _each("length(c_name)::VARCHAR"))
def action_user_function(spark, d):
    return _acted(spark, d, udf_action(lambda x: [x[::-1], str(len(x))]))


@query(_each("'http://x/a/' || replace(c_mktsegment || ' s', ' ', '%20')"))
def action_toiri(spark, d):
    return _acted(spark, d, toiri(column_action(lambda c: F.concat(c, F.lit(" s")), attr("seg")), "http://x/a/b", ignore_refs=False))


@query(_each("'is ' || c_name") + " UNION ALL " + _each("'is ' || c_mktsegment"))
def action_from_template(spark, d):
    said = action_template(column_action(lambda c: F.concat(F.lit("is "), c), var("what")))
    return _acted(spark, d, values(said(what=target()), said(what=attr("seg"))))


@query("SELECT 'tpch:customer/' || c_custkey AS origin, r AS rel, t AS target FROM customer, (VALUES ('p'), ('q')) a(r), (VALUES ('x'), ('y'), ('z')) b(t)")
def action_foreach_product(spark, d):
    return _acted(spark, d, foreach(rel=["p", "q"], target=["x", "y", "z"], action=link()), whole=True)


@query("SELECT 'tpch:customer/' || c_custkey AS origin, 'letter' AS rel, substr(c_name, i::INT, 1) AS target FROM customer, range(1, 4) t(i) GROUP BY ALL")
def action_relation(spark, d):
    def letters(frames):
        for f in frames:
            rows = [(o, "letter", c, False) for o, t in zip(f["origin"], f["target"]) for c in t[:3]]
            yield pd.DataFrame(rows, columns=["origin", "rel", "target", "target_is_iri"])

    return _acted(spark, d, relation_action(letters), whole=True)


# --- pipelines


@query("SELECT 'tpch:vocab/c_name' AS rule, count(*) AS n FROM customer UNION ALL SELECT 'tpch:vocab/c_nationkey', count(*) FROM customer")
def pipeline_firings(spark, d):
    return _people(spark, d).firings


@query(_CUSTOMERS + " UNION ALL SELECT 'tpch:customer/' || c_custkey, 'copied', 'from ' || c_name FROM customer")
def pipeline_own_stages(spark, d):
    class Mine(Definition):
        @stage(2)
        def say(self):
            self.output = self.output.union(Linkset.from_columns(self.model.df, F.col("origin"), F.lit("copied"), F.concat(F.lit("from "), "target")))
            return False

        @stage(1)
        def keep(self):
            self.output = self.output.union(Linkset(self.model.df.withColumn("attrs", F.slice("attrs", 1, 0))))

        @stage(3)
        def never(self):
            raise AssertionError("a stage that gives False is the last")

    return lot(Mine().run(_customers(spark, d)))


def _typed_model(spark, d) -> Linkset:
    return rows_as_links(table(spark, d, "customer"), "customer", "c_custkey", ["c_name", "c_mktsegment"])


@query("SELECT 'http://by' AS rel, count(DISTINCT c_name) + count(DISTINCT c_mktsegment) AS n FROM customer UNION ALL SELECT 'http://k', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'http://n', count(DISTINCT c_name) FROM customer")
def pipeline_typed_rules_and_hooks(spark, d):
    """Rules for output types, ids by a function of one's own, and links that a hook gives every entity."""
    rules = {rel("customer"): materialize("P", fprint=[("n", follow(rel("c_name")))], vars={"s": follow(rel("c_mktsegment"))}, links=[("seg", materialize("S", attach=False, fprint=[("k", var("s"))]))])}
    transform = {(rel("c_name"), "P"): link(rel="http://n"), (rel("c_mktsegment"), "S"): link(rel="http://k"), (rel("c_name"), "nothing"): link(rel="http://never")}
    by = lambda ids: Linkset.from_columns(ids, F.col("out_rid"), F.lit("http://by"), F.lit("hook"))
    own = lambda etype, keys, vals: F.concat(etype, F.lit(":"), F.array_join(vals, "|"))
    out = Pipeline(rules, transform, hooks=[by], id_helper=own).run(_typed_model(spark, d)).output
    return out.df.where("rel like 'http://%' and (rel <> 'http://n' or origin = concat('P:', target)) and (rel <> 'http://k' or origin = concat('S:', target))").where(F.col("rel").isin("http://by", "http://k", "http://n")).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT rel, target, count(*) AS n FROM (SELECT DISTINCT c_name, rel, target FROM (SELECT c_name, unnest(['{TYPE}', '{LABEL}', 'n', 's']) AS rel, unnest(['P', c_name, c_name, c_mktsegment]) AS target FROM customer)) GROUP BY ALL""")
def pipeline_incremental(spark, d):
    """Batch by batch what one run over all gives: the second batch says more of entities that the first has made."""
    src, out = shared_dir(spark), shared_dir(spark)
    m = _typed_model(spark, d)
    p = Pipeline({rel("customer"): materialize("P", fprint=[("n", follow(rel("c_name")))])}, {rel("c_name"): link(rel="n"), rel("c_mktsegment"): link(rel="s")}, {"P": follow("n")})
    for part in (m.without_rels([rel("c_mktsegment")]), m):
        part.df.write.mode("append").parquet(src)
        run_pipeline(read_links(spark, src), p, out, f"{out}/log").awaitTermination()
    return spark.read.parquet(f"{out}/links").groupBy("rel", "target").agg(F.count(F.lit(1)).alias("n"))


# --- streams

_QUIET = "(SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)"


def _closed_events(spark, d, columns: list[str]) -> DataFrame:
    """The events as a stream, and one long after all others, which closes what the watermark keeps open."""
    src = shared_dir(spark)
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), *columns)
    last = e.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select("ts", *[F.lit(None).cast(dict(e.dtypes)[c]).alias(c) for c in columns])
    e.unionByName(last).write.parquet(src)
    return spark.readStream.schema(e.schema).parquet(src)


@query(f"""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM {_QUIET}) GROUP BY user_id, s""")
def stream_sessions(spark, d):
    out = shared_dir(spark)
    s = sessions(_closed_events(spark, d, ["user_id"]), "ts", ["user_id"], "1 day", "1 hour")
    rows = to_completion(s, f"{out}/rows", f"{out}/log").where("user_id is not null")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT DISTINCT event_type, user_id FROM events")
def stream_of_new_links(spark, d):
    out = shared_dir(spark)
    rows = unseen(_closed_events(spark, d, ["event_type", "user_id"]), "ts", "10000 days", ["event_type", "user_id"])
    return to_completion(rows, f"{out}/rows", f"{out}/log").where("user_id is not null").select("event_type", "user_id")


@query("SELECT DISTINCT origin, rel, target FROM relationship")
def stream_of_link_files(spark, d):
    src, out = shared_dir(spark), shared_dir(spark)
    links(spark, d).unique().df.write.parquet(src)
    return to_completion(lot(read_links(spark, src)), f"{out}/rows", f"{out}/log")


# --- the command line


@query(_NATIONS + " UNION ALL SELECT 'tpch:nation/' || n_nationkey, 'tpch:vocab/n_regionkey', 'tpch:region/' || n_regionkey FROM nation UNION ALL SELECT 'tpch:nation/' || n_nationkey, '{TYPE}', 'tpch:vocab/nation' FROM nation")
def command_parse(spark, d):
    """Through every format that both ends know."""
    path = shared_dir(spark)
    storage.save(_nations(spark, d), f"{path}/0.parquet")
    for a, b in (("0.parquet", "1.nt"), ("1.nt", "2.json"), ("2.json", "3.vlit"), ("3.vlit", "4.parquet")):
        cli.main(["parse", f"{path}/{a}", f"{path}/{b}"])
    return lot(cli.read(spark, f"{path}/4.parquet"))


_RULES = """from linkframe.plans.pipeline import *
RULES = Pipeline({"tpch:vocab/nation": materialize(COPY())})
"""


@query(_NATIONS)
def command_transform(spark, d):
    import tempfile

    path = shared_dir(spark)
    storage.save(_nations(spark, d), f"{path}/in.parquet")
    with tempfile.NamedTemporaryFile("w", suffix=".py") as f:  # read by this process only
        f.write(_RULES)
        f.flush()
        cli.main(["transform", f.name, f"{path}/in.parquet", f"{path}/out.parquet", "--exclude-rel", rel("n_regionkey")])
    return lot(cli.read(spark, f"{path}/out.parquet").without_rels([TYPE]))


@query("SELECT 'n' || n_nationkey AS origin, 'http://www.w3.org/2005/Atom#title' AS rel, n_name AS target FROM nation")
def command_atom(spark, d):
    path = shared_dir(spark)
    feed = F.format_string(_FEED, F.col("n_nationkey").cast("string"), F.col("n_name"), F.col("n_regionkey").cast("string"))
    table(spark, d, "nation").select(feed.alias("value")).repartition(32).write.option("maxRecordsPerFile", 1).text(f"{path}/in")
    cli.main(["atom", f"{path}/in", f"{path}/out.nt"])
    return lot(cli.read(spark, f"{path}/out.nt").match(None, "http://www.w3.org/2005/Atom#title"))


@query("SELECT term AS origin, 'http://www.w3.org/2000/01/rdf-schema#label' AS rel, col_name AS target FROM vocabulary")
def command_rdfs(spark, d):
    path = shared_dir(spark)
    v = table(spark, d, "vocabulary")
    storage.save(Linkset.from_columns(v, F.col("term"), F.lit(LABEL), F.col("col_name")), f"{path}/in.parquet")
    cli.main(["rdfs", f"{path}/in.parquet", f"{path}/out.nt"])
    return lot(cli.read(spark, f"{path}/out.nt"))


@query("SELECT 'tpch:nation/' || n_nationkey AS n, n_name AS t FROM nation")
def command_query(spark, d):
    import contextlib
    import io

    path, said = shared_dir(spark), io.StringIO()
    storage.save(_nations(spark, d), f"{path}/in.parquet")
    with contextlib.redirect_stdout(said):
        cli.main(["query", f"{path}/in.parquet", f"?($n, '{rel('n_name')}', $t)"])
    return spark.createDataFrame([tuple(x.split("\t")) for x in said.getvalue().splitlines()], "n string, t string")


