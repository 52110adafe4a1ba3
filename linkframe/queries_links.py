"""Queries over links: every one over whole tables, with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkframe.functions.hashing import hash_id
from linkframe.functions.text import ifexists, lookup, regex_group, replace_from, short_slug, slug, split_clean
from linkframe.operators.graph import ancestors, closure, follow, follow_star, zoom
from linkframe.operators.linkset import Linkset, attr
from linkframe.plans.mapping import event_links, item_links, places, rel, rows_as_links, star
from linkframe.plans.pipeline import COPY, Pipeline, contains, follow as f_follow, if_, link, materialize, target, var
from linkframe.plans.query import bindings, var_sets
from linkframe.schema import LABEL, NS, REFINES, TYPE, shared_dir, table
from linkframe.sources import formats, literate, storage, templates
from linkframe.streaming import to_completion, window_counts

V = "http://terms.shelf.example/vocab/"
CLASS = V + "class/"
MAIN = "http://shelf.example/catalogue/main"
VTYPE, VLABEL = V + "type", V + "label"

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("{V}", V).replace("{MAIN}", MAIN).replace("{TYPE}", TYPE).replace("{LABEL}", LABEL).replace("{NS}", NS)
        return f

    return register


def links(spark: SparkSession, d: str, attrs: bool = False) -> Linkset:
    return storage.from_two_tables(table(spark, d, "relationship"), table(spark, d, "attribute") if attrs else None)


def lot(ls: Linkset) -> DataFrame:
    return ls.df.select("origin", "rel", "target")


# --- matching


@query("SELECT origin FROM relationship WHERE rel = '{V}subject' AND target = 'http://topics.shelf.example/subject/s002'")
def match_rel_target(spark, d):
    return links(spark, d).match(None, V + "subject", "http://topics.shelf.example/subject/s002").df.select("origin")


@query("SELECT origin, rel, target FROM relationship r WHERE EXISTS (SELECT 1 FROM attribute a WHERE a.rawid = r.rawid AND a.name = '@lang' AND a.value = 'en')")
def match_attr(spark, d):
    return lot(links(spark, d, True).match(attrs={"@lang": "en"}))


@query("""SELECT 'tpch:orders/' || l_orderkey AS origin, 'tpch:part/' || l_partkey AS target FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'""")
def match_attrs_of_edges(spark, d):
    return item_links(spark, d).match(attrs={"returnflag": "R", "linestatus": "F"}).df.select("origin", "target")


@query("SELECT count(*) AS n_links, count(DISTINCT a.rawid) AS n_with_attrs FROM relationship r LEFT JOIN (SELECT DISTINCT rawid FROM attribute) a USING (rawid)")
def match_wildcard_counts(spark, d):
    return links(spark, d, True).match("", [], None, {}).df.agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.size("attrs") > 0).alias("n_with_attrs"))


@query("SELECT origin, rel, target FROM relationship WHERE rel IN ('{V}cites', '{V}partOf', '{V}quotes')")
def multimatch_sets(spark, d):
    return lot(links(spark, d).multimatch(None, {V + "cites", V + "partOf", V + "quotes"}))


@query("SELECT origin, rel, target FROM relationship WHERE target IN (SELECT iri FROM authority)")
def multimatch_large_set(spark, d):
    return lot(links(spark, d).match_any("target", table(spark, d, "authority").select("iri")))


@query("SELECT r.origin, r.rel, r.target FROM relationship r WHERE rel = '{V}label' AND EXISTS (SELECT 1 FROM attribute a WHERE a.rawid = r.rawid AND name = '@lang' AND value = 'fr')")
def two_tables_match(spark, d):
    return storage.match_two_tables(table(spark, d, "relationship"), table(spark, d, "attribute"), rel=VLABEL, attrs={"@lang": "fr"}).select("origin", "rel", "target")


@query("SELECT rel, count(*) AS n FROM relationship GROUP BY rel")
def links_count_by_rel(spark, d):
    return links(spark, d).counts("rel")


@query("SELECT count(*) AS n_links FROM relationship")
def size(spark, d):
    return links(spark, d).count()


@query("SELECT DISTINCT origin FROM relationship WHERE rel = '{V}type' AND target = '{V}class/Person'")
def origins_by_type(spark, d):
    return links(spark, d).origins({CLASS + "Person"}, VTYPE)


@query("SELECT DISTINCT origin FROM relationship WHERE rel = '{V}type'")
def origins_any_type(spark, d):
    return links(spark, d).origins("*", VTYPE)


@query("SELECT DISTINCT rel FROM relationship")
def column_distinct_rel(spark, d):
    return links(spark, d).column("rel")


@query("SELECT target FROM relationship WHERE origin = '{MAIN}' AND rel = '{V}holds'")
def lookup_targets(spark, d):
    return links(spark, d).targets(MAIN, V + "holds").select("target")


@query("SELECT DISTINCT origin FROM relationship WHERE rel = '{V}type' AND target = '{V}class/Book'")
def lookup_byvalue(spark, d):
    return links(spark, d).origins_of(VTYPE, CLASS + "Book")


@query("SELECT origin, arg_min(target, rawid) AS target FROM relationship WHERE rel = '{V}label' GROUP BY origin")
def simple_lookup_first(spark, d):
    return links(spark, d).match(None, VLABEL).first(["origin"])


@query("SELECT origin, arg_min(target, rawid) AS target FROM relationship WHERE rel = '{V}type' GROUP BY origin")
def first_type(spark, d):
    return links(spark, d).match(None, VTYPE).first(["origin"])


@query("SELECT origin, count(*) AS n FROM relationship WHERE rel = '{V}type' GROUP BY origin")
def resource_types(spark, d):
    return links(spark, d).types(type_rel=VTYPE).groupBy("origin").agg(F.count("type").alias("n"))


@query("SELECT origin, target AS label FROM relationship WHERE rel = '{V}label'")
def resource_labels(spark, d):
    return links(spark, d).labels(label_rel=VLABEL)


# --- grouping


@query("SELECT origin, string_agg(target, '|' ORDER BY target) AS creators FROM relationship WHERE rel = '{V}creator' GROUP BY origin")
def static_index_multi(spark, d):
    return links(spark, d).index(V + "creator").select("origin", F.array_join("values", "|").alias("creators"))


@query("SELECT origin, count(*) AS n_links, count(DISTINCT rel) AS n_rels FROM relationship GROUP BY origin")
def origin_view_counts(spark, d):
    rels = F.array_distinct(F.transform("links", lambda x: x.rel))
    return links(spark, d).by_origin().select("origin", F.size("links").cast("bigint").alias("n_links"), F.size(rels).cast("bigint").alias("n_rels"))


@query("""SELECT origin, coalesce(string_agg(DISTINCT target, '|' ORDER BY target) FILTER (rel = '{V}label'), '') AS label, coalesce(string_agg(DISTINCT target, '|' ORDER BY target) FILTER (rel = '{V}creator'), '') AS creator
    FROM relationship WHERE rel IN ('{V}label', '{V}creator') GROUP BY origin""")
def omap_pivot(spark, d):
    return links(spark, d).pivot({"label": VLABEL, "creator": V + "creator"})


@query("""SELECT origin, coalesce(string_agg(DISTINCT target, '|' ORDER BY target) FILTER (rel = '{V}label'), '') AS label, coalesce(string_agg(DISTINCT target, '|' ORDER BY target) FILTER (rel = '{V}pageCount'), '') AS pages
    FROM relationship WHERE origin IN (SELECT origin FROM relationship WHERE rel = '{V}type' AND target = '{V}class/Book') GROUP BY origin""")
def csv_write_pivot(spark, d):
    return templates.to_csv_rows(links(spark, d), {"label": VLABEL, "pages": V + "pageCount"}, [CLASS + "Book"], VTYPE)


@query("SELECT origin, string_agg(target, ',' ORDER BY rawid) AS items FROM relationship WHERE rel = '{V}creator' GROUP BY origin")
def list_items_ordered(spark, d):
    return links(spark, d).list_items(V + "creator").select("origin", F.array_join("items", ",").alias("items"))


@query("SELECT r.origin, r.rel, r.target, a.name, a.value FROM relationship r LEFT JOIN attribute a ON a.rawid = r.rawid")
def attr_flatten(spark, d):
    return links(spark, d, True).flatten()


@query("""SELECT origin, list_reduce(list_sort(list(rel || '=' || n)), lambda x, y: x || ';' || y) AS rels FROM (SELECT origin, rel, count(*) AS n FROM relationship GROUP BY ALL) GROUP BY origin""")
def nested_form(spark, d):
    rels = F.array_sort(F.transform(F.map_entries("rels"), lambda e: F.concat(e.key, F.lit("="), F.size(e.value).cast("string"))))
    return links(spark, d).nested().select("origin", F.array_join(rels, ";").alias("rels"))


@query("SELECT origin, rel, target FROM relationship WHERE rel IN ('{V}cites', '{V}extent')")
def nested_round_trip(spark, d):
    return lot(Linkset.from_nested(links(spark, d).match(None, {V + "cites", V + "extent"}).nested()))


@query("SELECT r.origin, r.rel, r.target, a.name, a.value FROM relationship r LEFT JOIN attribute a ON a.rawid = r.rawid")
def nested_round_trip_whole(spark, d):
    return Linkset.from_nested(links(spark, d, True).nested()).flatten()


# --- sets and changes


@query("SELECT origin, rel, target, min(rawid) AS link_id FROM relationship GROUP BY origin, rel, target")
def uniquify(spark, d):
    return links(spark, d).unique().df.select("origin", "rel", "target", "link_id")


@query("SELECT DISTINCT 'tpch:user/' || user_id AS origin, 'tpch:vocab/' || event_type AS rel, json_extract_string(props, '$.k') AS k FROM events")
def uniquify_with_attributes(spark, d):
    e = event_links(spark, d)
    same = Linkset(e.df.withColumns({"target": F.lit("x"), "attrs": F.filter("attrs", lambda a: a["name"] == "k"), "link_id": F.lit(None).cast("bigint")}))
    return same.unique().df.select("origin", "rel", attr(F.col("attrs"), "k").alias("k"))


@query("SELECT rel, count(*) AS n FROM (SELECT DISTINCT origin, rel, target FROM relationship WHERE rel IN ('{V}label', '{V}subject')) GROUP BY rel")
def union_models(spark, d):
    a, b = links(spark, d).match(None, VLABEL), links(spark, d).match(None, {VLABEL, V + "subject"})
    return a.union(b).df.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT origin, rel, target FROM relationship r WHERE NOT EXISTS (SELECT 1 FROM relationship x WHERE x.deleted_at IS NOT NULL AND x.origin = r.origin AND x.rel = r.rel AND x.target = r.target)")
def except_disjoint(spark, d):
    gone = storage.from_two_tables(table(spark, d, "relationship").where("deleted_at is not null"), None)
    return lot(links(spark, d).minus(gone))


@query("SELECT origin, rel, target FROM relationship r WHERE EXISTS (SELECT 1 FROM relationship x WHERE x.deleted_at IS NOT NULL AND x.origin = r.origin AND x.rel = r.rel AND x.target = r.target)")
def intersect_models(spark, d):
    gone = storage.from_two_tables(table(spark, d, "relationship").where("deleted_at is not null"), None)
    return lot(links(spark, d).intersect(gone))


@query("SELECT rel, count(*) AS n FROM relationship WHERE deleted_at IS NULL GROUP BY rel")
def remove_ids(spark, d):
    gone = table(spark, d, "relationship").where("deleted_at is not null").select("rawid")
    return links(spark, d).remove(gone).df.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_number() OVER (ORDER BY rawid) - 1 AS link_id, origin, rel, target FROM relationship WHERE deleted_at IS NULL")
def numbered_again(spark, d):
    """Links are taken out, and the ids of those left move up."""
    gone = table(spark, d, "relationship").where("deleted_at is not null").select("rawid")
    return links(spark, d).remove(gone).numbered().df.select("link_id", "origin", "rel", "target")


@query("SELECT origin, rel, target, count(*)::BIGINT AS surplus FROM relationship WHERE deleted_at IS NOT NULL GROUP BY ALL")
def model_differences(spark, d):
    live = storage.from_two_tables(table(spark, d, "relationship").where("deleted_at is null"), None)
    return links(spark, d).differences(live).select("origin", "rel", "target", F.col("surplus").cast("bigint").alias("surplus"))


@query("SELECT CASE origin WHEN '{MAIN}' THEN 'urn:main' WHEN 'http://shelf.example/catalogue/annex' THEN 'urn:annex' ELSE origin END AS origin, count(*) AS n FROM relationship GROUP BY 1")
def replace_origin(spark, d):
    new = links(spark, d).replace_origins({MAIN: "urn:main", "http://shelf.example/catalogue/annex": "urn:annex"})
    return new.df.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN a.label IS NOT NULL THEN a.label ELSE origin END AS origin, count(*) AS n FROM relationship r LEFT JOIN authority a ON a.iri = r.origin GROUP BY 1")
def replace_origin_table(spark, d):
    new = links(spark, d).replace_origins_from(table(spark, d, "authority").where("label is not null"), "iri", "label")
    return new.df.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE origin WHEN '{V}class/Book' THEN 'urn:b' ELSE origin END AS origin, rel, CASE target WHEN '{V}class/Book' THEN 'urn:b' ELSE target END AS target FROM relationship""")
def replace_entity(spark, d):
    return lot(links(spark, d).replace_entity(CLASS + "Book", "urn:b"))


@query("SELECT origin, count(*) AS n FROM (SELECT origin FROM relationship UNION ALL SELECT 'urn:copy' FROM relationship WHERE origin = '{MAIN}' AND rel = '{V}holds') GROUP BY origin")
def duplicate_statements(spark, d):
    return links(spark, d).duplicate(MAIN, "urn:copy", F.col("rel") == V + "holds").df.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT origin, rel, target FROM relationship WHERE rel IN ('{V}cites', '{V}remark')")
def only_rel(spark, d):
    return lot(links(spark, d).only_rels([V + "cites", V + "remark"]))


@query("SELECT rel, count(*) AS n FROM relationship WHERE rel NOT IN ('{V}type', '{V}label') GROUP BY rel")
def exclude_rel(spark, d):
    return links(spark, d).without_rels([VTYPE, VLABEL]).df.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


# --- the query language

NAMES = {"V": V, "C": CLASS, "R": rel("")}


@query("SELECT DISTINCT origin AS a, target AS s FROM relationship WHERE rel = '{V}subject'")
def bgp_single(spark, d):
    return bindings(links(spark, d), "?($a, V 'subject', $s)", NAMES)


@query("SELECT DISTINCT r.origin AS b, r.target AS p FROM relationship r JOIN relationship t ON t.origin = r.target WHERE r.rel = '{V}creator' AND t.rel = '{V}type' AND t.target = '{V}class/Person'")
def bgp_and_2(spark, d):
    return bindings(links(spark, d), "?($b, V 'creator', $p) and ?($p, V 'type', C 'Person')", NAMES)


@query("""SELECT DISTINCT 'tpch:orders/' || o_orderkey AS o, 'tpch:region/' || n_regionkey AS r FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '1-URGENT'""")
def bgp_and_3hop(spark, d):
    return bindings(star(spark, d), "?($o, R 'o_orderpriority', '1-URGENT') and ?($o, R 'o_custkey', $c) and ?($c, R 'c_nationkey', $n) and ?($n, R 'n_regionkey', $r)", NAMES).select("o", "r").distinct()


@query("SELECT DISTINCT 'tpch:customer/' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3")
def bgp_or(spark, d):
    return bindings(star(spark, d), "?($c, R 'c_mktsegment', 'BUILDING') or ?($c, R 'c_nationkey', 'tpch:nation/3')", NAMES)


@query("SELECT DISTINCT 'tpch:customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def bgp_not(spark, d):
    return bindings(star(spark, d), "?($c, R 'c_mktsegment', *) and not (?($o, R 'o_custkey', $c) and ?($o, R 'o_orderpriority', '1-URGENT'))", NAMES)


@query("""SELECT 'c' AS var, 'tpch:customer/' || c_custkey AS value FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION SELECT 'o', 'tpch:orders/' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def bgp_compat_sets(spark, d):
    return var_sets(star(spark, d), "?($c, R 'c_mktsegment', 'BUILDING') and ?($o, R 'o_custkey', $c)", NAMES, compat=True)


@query("SELECT DISTINCT origin AS x FROM relationship WHERE origin = target")
def bgp_same_variable(spark, d):
    return bindings(links(spark, d), "?($x, *, $x)")


# --- paths


@query("SELECT r.origin, x.target FROM relationship r JOIN relationship x ON x.origin = r.target WHERE r.rel = '{V}creator' AND x.rel = '{V}label'")
def follow_2hop(spark, d):
    return follow(links(spark, d), [V + "creator", VLABEL])


@query("""SELECT 'tpch:orders/' || o_orderkey AS origin, r_name AS target FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def follow_4hop(spark, d):
    return follow(star(spark, d), [rel("o_custkey"), rel("c_nationkey"), rel("n_regionkey"), rel("r_name")])


@query("""SELECT origin, string_agg(target, '|' ORDER BY target) FILTER (rel = '{V}label') AS labels, string_agg(target, '|' ORDER BY target) FILTER (rel = '{V}subject') AS subjects FROM relationship WHERE rel IN ('{V}label', '{V}subject') GROUP BY origin""")
def follow_star_one_pass(spark, d):
    out = follow_star(links(spark, d), [VLABEL, V + "subject"])
    text = lambda c: F.when(F.size(F.col(f"`{c}`")) > 0, F.array_join(F.col(f"`{c}`"), "|"))
    return out.select("origin", text(VLABEL).alias("labels"), text(V + "subject").alias("subjects"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT origin, target FROM relationship WHERE rel IN ('{V}partOf', '{V}cites', '{V}continues')), t AS (SELECT origin, target FROM e UNION SELECT t.origin, e.target FROM t JOIN e ON e.origin = t.target) SELECT origin, target FROM t""")
def transitive_closure(spark, d):
    return closure(links(spark, d), [V + "partOf", V + "cites", V + "continues"]).select("origin", "target")


@query("""SELECT 'tpch:customer/' || c_custkey AS origin, 'tpch:region/' || n_regionkey || '|' || 'tpch:nation/' || c_nationkey AS ancestors FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT 'tpch:nation/' || n_nationkey, 'tpch:region/' || n_regionkey FROM nation""")
def ancestors_of_places(spark, d):
    return ancestors(places(spark, d), rel("in")).select("origin", F.array_join("ancestors", "|").alias("ancestors"))


@query("""WITH f AS (SELECT DISTINCT origin AS n FROM relationship WHERE rel = '{V}partOf'), s AS (SELECT n FROM f UNION SELECT target FROM relationship JOIN f ON origin = n),
    s2 AS (SELECT n FROM s UNION SELECT target FROM relationship JOIN s ON origin = n) SELECT origin, rel, target FROM relationship WHERE origin IN (SELECT n FROM s2)""")
def zoom_depth2(spark, d):
    ls = links(spark, d)
    return lot(zoom(ls, ls.match(None, V + "partOf").df.select("origin"), 2)[0])


# --- functions


@query("SELECT origin, count(*) AS n FROM relationship r WHERE origin IN (SELECT origin FROM relationship WHERE rel = '{V}subject' AND target IN ('http://topics.shelf.example/subject/s002', 'http://topics.shelf.example/subject/s039')) GROUP BY origin")
def contains_filter(spark, d):
    wanted = F.array(*[F.lit(f"http://topics.shelf.example/subject/{s}") for s in ("s002", "s039")])
    hit = links(spark, d).index(V + "subject").where(F.arrays_overlap("values", wanted)).select("origin")
    return links(spark, d).match_any("origin", hit).df.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT iri, CASE WHEN rtype IS NOT NULL AND rtype <> '' THEN rtype ELSE 'none' END AS kind FROM resources")
def ifexists_values(spark, d):
    return table(spark, d, "resources").select("iri", ifexists(F.col("rtype"), F.col("rtype"), F.lit("none")).alias("kind"))


@query("SELECT rawid, CASE rel WHEN '{V}label' THEN 'L' WHEN '{V}type' THEN 'T' ELSE 'miss' END AS short FROM relationship")
def lookup_map_onmiss(spark, d):
    return table(spark, d, "relationship").select("rawid", lookup(F.col("rel"), {VLABEL: "L", VTYPE: "T"}, "miss").alias("short"))


@query("SELECT rawid, CASE WHEN regexp_matches(origin, '^(?:https?://([^/]+)/.*)') THEN regexp_extract(origin, '^(?:https?://([^/]+)/.*)', 1) ELSE origin END AS host FROM relationship")
def regex_group_values(spark, d):
    return table(spark, d, "relationship").select("rawid", regex_group(F.col("origin"), r"https?://([^/]+)/.*").alias("host"))


@query("""SELECT book_id, CASE WHEN regexp_matches(publisher, '^(?:Edition)') THEN regexp_replace(publisher, 'Edition', 'Ed.', 'g') WHEN regexp_matches(publisher, '^(?:[A-Z]+ )') THEN regexp_replace(publisher, '[A-Z]+ ', '', 'g') ELSE publisher END AS name FROM books""")
def replace_from_values(spark, d):
    return table(spark, d, "books").select("book_id", replace_from(F.col("publisher"), [("[A-Z]+ ", ""), ("Edition", "Ed.")]).alias("name"))


@query("SELECT rawid, trim(f) AS field FROM (SELECT rawid, unnest(string_split(target, ';')) AS f FROM relationship WHERE rel = '{V}extent') WHERE trim(f) <> ''")
def split_targets(spark, d):
    return table(spark, d, "relationship").where(F.col("rel") == V + "extent").select("rawid", F.explode(split_clean(F.col("target"), ";")).alias("field"))


@query("SELECT book_id, substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]', '_', 'g'), '_{2,}', '_', 'g'), 1, 12) AS slug FROM books")
def short_slugs(spark, d):
    return table(spark, d, "books").select("book_id", short_slug(F.col("title"), 12).alias("slug"))


@query("""SELECT book_id, lower(regexp_replace(trim(regexp_replace(regexp_replace(strip_accents(title), '[^\\x00-\\x7F]', '', 'g'), '[^\\w\\s-]', '', 'g')), '[-\\s_]+', '-', 'g')) AS slug FROM books""")
def slugs(spark, d):
    return table(spark, d, "books").select("book_id", slug(F.col("title")).alias("slug"))


@query()
def hash_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", hash_id(F.col("c_name")).alias("id"))


# --- formats


@query("""SELECT 'tpch:nation/' || n_nationkey AS origin, 'tpch:vocab/n_name' AS rel, n_name AS target FROM nation UNION ALL SELECT 'tpch:nation/' || n_nationkey, 'tpch:vocab/n_regionkey', 'tpch:region/' || n_regionkey FROM nation
    UNION ALL SELECT 'tpch:nation/' || n_nationkey, '{TYPE}', 'tpch:vocab/nation' FROM nation UNION ALL SELECT 'tpch:customer/' || c_custkey, 'tpch:vocab/c_name', c_name FROM customer""")
def ntriples_round_trip(spark, d):
    m = rows_as_links(table(spark, d, "nation"), "nation", "n_nationkey", ["n_name"], {"n_regionkey": "region"}).union(rows_as_links(table(spark, d, "customer"), "customer", "c_custkey", ["c_name"], typed=False))
    return lot(formats.ntriples(formats.to_ntriples(m)))


_PLACES = """SELECT 'tpch:customer/' || c_custkey AS origin, 'tpch:vocab/in' AS rel, 'tpch:nation/' || c_nationkey AS target FROM customer UNION ALL SELECT 'tpch:nation/' || n_nationkey, 'tpch:vocab/in', 'tpch:region/' || n_regionkey FROM nation"""


@query(_PLACES)
def json_round_trip(spark, d):
    path = shared_dir(spark)
    formats.to_json_lines(places(spark, d)).write.text(path)
    return lot(formats.read_json_dump(spark, path, by_line=True))


@query(_PLACES)
def literate_round_trip(spark, d):
    path = shared_dir(spark)
    literate.write(places(spark, d), path)
    return lot(literate.read(spark, path))


@query("SELECT DISTINCT origin, rel, name, value FROM relationship r JOIN attribute a USING (rawid) WHERE r.rel = '{V}cites' AND name IS NOT NULL AND value IS NOT NULL")
def two_tables_round_trip(spark, d):
    rel_, att = storage.to_two_tables(links(spark, d, True).match(None, V + "cites"))
    return storage.from_two_tables(rel_, att).flatten().where("name is not null and value is not null").select("origin", "rel", "name", "value").distinct()


@query("SELECT r.origin, r.rel, r.target, a.name, a.value FROM relationship r LEFT JOIN attribute a ON a.rawid = r.rawid")
def two_tables_round_trip_whole(spark, d):
    return storage.from_two_tables(*storage.to_two_tables(links(spark, d, True))).flatten()


BOOKS = """# http://shelf.example/books/{book_id} [http://schema.org/Book]

* <http://schema.org/name>: {title}
* <http://schema.org/author>: {author}
    * <http://schema.org/birthDate>: {author_date}
* <http://schema.org/publisher>: <http://shelf.example/publisher/{publisher}>
"""


@query("""SELECT 'http://shelf.example/books/' || book_id AS origin, '{TYPE}' AS rel, 'http://schema.org/Book' AS target, NULL AS born FROM books UNION ALL SELECT 'http://shelf.example/books/' || book_id, 'http://schema.org/name', title, NULL FROM books WHERE title IS NOT NULL
    UNION ALL SELECT 'http://shelf.example/books/' || book_id, 'http://schema.org/author', author, author_date FROM books WHERE author IS NOT NULL
    UNION ALL SELECT 'http://shelf.example/books/' || book_id, 'http://schema.org/publisher', 'http://shelf.example/publisher/' || publisher, NULL FROM books WHERE publisher IS NOT NULL""")
def csv_template_ingest(spark, d):
    m = templates.ingest(table(spark, d, "books"), BOOKS)
    return m.df.select("origin", "rel", "target", attr(F.col("attrs"), "http://schema.org/birthDate").alias("born"))


@query("""SELECT term AS origin, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS rel, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#Property' AS target FROM vocabulary UNION ALL SELECT term, 'http://www.w3.org/2000/01/rdf-schema#label', col_name FROM vocabulary
    UNION ALL SELECT term, 'http://www.w3.org/2000/01/rdf-schema#subPropertyOf', value_type FROM vocabulary""")
def rdfs_map(spark, d):
    v = table(spark, d, "vocabulary")
    make = lambda r, t: Linkset.from_columns(v, F.col("term"), F.lit(r), t)
    return lot(formats.rdfs(make(TYPE, F.lit(NS + "Property")).union(make(LABEL, F.col("col_name")), make(REFINES, F.col("value_type")), dedup=False)))


@query("""WITH e AS (SELECT 'tpch:customer/' || c_custkey AS a, 'tpch:nation/' || c_nationkey AS b FROM customer UNION ALL SELECT 'tpch:nation/' || n_nationkey, 'tpch:region/' || n_regionkey FROM nation),
    n AS (SELECT node, split_part(node, '/', 2) AS t, row_number() OVER (PARTITION BY split_part(node, '/', 2) ORDER BY node) AS r FROM (SELECT a AS node FROM e UNION SELECT b FROM e)),
    s AS (SELECT node, t || CASE WHEN r > 1 THEN '_' || (r - 1) ELSE '' END || '(' || t || ')' AS x FROM n) SELECT '    ' || p.x || ' -->|in| ' || q.x AS value FROM e JOIN s p ON p.node = a JOIN s q ON q.node = b""")
def mermaid_edges(spark, d):
    return formats.mermaid(places(spark, d))


@query("""WITH r AS (SELECT r_regionkey AS k, '{"@id":"tpch:region/' || r_regionkey || '","@type":"region","r_name":"' || r_name || '"}' AS j FROM region),
    n AS (SELECT n_nationkey AS k, '{"@id":"tpch:nation/' || n_nationkey || '","@type":"nation","n_name":"' || n_name || '","n_regionkey":' AS h, n_regionkey AS f FROM nation),
    c AS (SELECT c_custkey AS k, '{"@id":"tpch:customer/' || c_custkey || '","@type":"customer","c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' AS h, c_nationkey AS f FROM customer)
    SELECT 'tpch:orders/' || o_orderkey AS origin, '{"@id":"tpch:orders/' || o_orderkey || '","@type":"orders","o_custkey":' || c.h || '{"@id":"tpch:nation/' || c.f || '"}},"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' AS value FROM orders JOIN c ON c.k = o_custkey
    UNION ALL SELECT 'tpch:customer/' || c.k, c.h || n.h || '{"@id":"tpch:region/' || n.f || '"}}}' FROM c JOIN n ON n.k = c.f WHERE c.k NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'tpch:nation/' || n.k, n.h || r.j || '}' FROM n JOIN r ON r.k = n.f WHERE n.k NOT IN (SELECT c_nationkey FROM customer)""")
def jsonld_nest(spark, d):
    return formats.jsonld(star(spark, d), rel(""))


@query("SELECT origin, rel, target FROM relationship")
def shortened_round_trip(spark, d):
    return lot(storage.restored(*storage.shortened(links(spark, d))))


@query("SELECT origin, rel, target FROM relationship WHERE origin = '{MAIN}'")
def saved_and_loaded(spark, d):
    path = shared_dir(spark)
    storage.save(links(spark, d), path)
    return lot(storage.load(spark, path).match(MAIN))


# --- pipelines

P = "http://people/"


def _people(spark, d):
    rules = {rel("customer"): materialize(P + "Person", fprint=[(P + "name", f_follow(rel("c_name")))], vars={"segment": f_follow(rel("c_mktsegment"))}, links=[(P + "segment", var("segment"))])}
    transform = {rel("c_name"): link(rel=P + "name"), rel("c_nationkey"): materialize(P + "Place", P + "lives", fprint=[(P + "key", target())], links=[(P + "key", target())])}
    model = rows_as_links(table(spark, d, "customer"), "customer", "c_custkey", ["c_name", "c_mktsegment"], {"c_nationkey": "nation"})
    return Pipeline(rules, transform, {P + "Person": f_follow(P + "name"), P + "Place": f_follow(P + "key")}).run(model)


@query("SELECT count(DISTINCT c_name) AS n_out, count(*) AS n_in FROM customer")
def pipeline_fingerprint(spark, d):
    return _people(spark, d).fingerprints.agg(F.countDistinct("out_rid").alias("n_out"), F.countDistinct("in_rid").alias("n_in"))


@query("""SELECT rel, count(*) AS n FROM (SELECT DISTINCT 'http://people/name' AS rel, c_name AS a, c_name AS b FROM customer UNION ALL SELECT DISTINCT 'http://people/segment', c_name, c_mktsegment FROM customer UNION ALL SELECT DISTINCT 'http://people/lives', c_name, c_nationkey::VARCHAR FROM customer
    UNION ALL SELECT DISTINCT 'http://people/key', c_nationkey::VARCHAR, '' FROM customer UNION ALL SELECT DISTINCT '{TYPE}', c_name, '' FROM customer UNION ALL SELECT DISTINCT '{TYPE}', c_nationkey::VARCHAR, '' FROM customer UNION ALL SELECT DISTINCT '{LABEL}', c_name, '' FROM customer UNION ALL SELECT DISTINCT '{LABEL}', c_nationkey::VARCHAR, '' FROM customer) GROUP BY rel""")
def pipeline_transform(spark, d):
    return _people(spark, d).output.df.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT c_name AS label FROM customer UNION SELECT DISTINCT 'tpch:nation/' || c_nationkey FROM customer")
def pipeline_labelize(spark, d):
    return _people(spark, d).output.match(None, LABEL).df.select(F.col("target").alias("label")).distinct()


@query("SELECT '{TYPE}' AS rel, count(*) AS n FROM customer UNION ALL SELECT 'tpch:vocab/c_mktsegment', count(*) FROM customer")
def pipeline_misses(spark, d):
    return _people(spark, d).misses.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'tpch:customer/' || c_custkey AS origin, 'tpch:vocab/c_name' AS rel, c_name AS target FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'tpch:customer/' || c_custkey, 'tpch:vocab/c_nationkey', 'tpch:nation/3' FROM customer WHERE c_nationkey = 3
    UNION ALL SELECT 'tpch:customer/' || c_custkey, '{TYPE}', 'tpch:vocab/customer' FROM customer WHERE c_nationkey = 3""")
def pipeline_copy_filter(spark, d):
    rules = {rel("customer"): if_(contains(f_follow(rel("c_nationkey")), "tpch:nation/3"), materialize(COPY()))}
    return lot(Pipeline(rules).run(rows_as_links(table(spark, d, "customer"), "customer", "c_custkey", ["c_name"], {"c_nationkey": "nation"})).output)


# --- streams


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_events_window(spark, d):
    """A tumbling window over the events as a stream. One event long after all others closes their windows, so every row
    comes out of the stream."""
    src, out = shared_dir(spark), shared_dir(spark)
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    last = events.agg((F.max("ts") + F.expr("interval 3 days")).alias("ts")).select("ts", F.lit("end of stream").alias("event_type"))
    events.unionByName(last).write.parquet(src)
    counts = window_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(src), "ts", ["event_type"], "1 hour", "1 hour")
    closed = to_completion(counts, f"{out}/closed", f"{out}/log").where("event_type <> 'end of stream'")
    return closed.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
