"""Links, queries, formats, storage: fixtures with known results, round trips and brute force."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkframe.functions import iri
from linkframe.functions.hashing import IdGen, id_of, ids_of
from linkframe.functions.text import ifexists, lookup, numeric_guard, regex_group, replace_from, short_slug, slug, split_clean
from linkframe.operators.graph import ancestors, closure, follow, follow_star, zoom
from linkframe.operators.linkset import Linkset
from linkframe.plans.query import QueryError, bindings, parse, var_sets
from linkframe.schema import ITEM, LABEL, NS, REFINES, TYPE
from linkframe.sources import formats, literate, storage, templates

DC = "http://purl.org/dc/elements/1.1/"
ONE, TWO = "http://one.example", "http://two.example"
RELS_DC = [
    (ONE, DC + "title", "Tide table", {"@lang": "en", "edition": "3"}), (ONE, DC + "publisher", "Harbour office", {"since": "1990"}), (TWO, DC + "title", "Tidevannstabell", {"@lang": "no", "edition": "3"}),
    (TWO, DC + "title", "Tide table", {"@lang": "en"}), (TWO, DC + "relation", ONE, {"kind": "translation", "since": "1991"}),
]
P = "http://ports.example/"
PORTS = [(P + "bergen", P + "title", "Bergen"), (P + "bergen", P + "near", P + "stade"), (P + "stade", P + "near", P + "bergen"), (P + "stade", P + "light", P + "stade"), (P + "kiel", P + "near", P + "stade"), (P + "kiel", P + "title", "Kiel", {"@lang": "de"})]


def triples(links):
    return sorted((r.origin, r.rel, r.target) for r in links.df.collect())


def full(links):
    return sorted((r.origin, r.rel, r.target, tuple((a.name, a.value) for a in r.attrs)) for r in links.df.collect())


def test_match(spark):
    m = Linkset.of(spark, RELS_DC)
    assert m.size() == 5 and m.match(ONE).size() == 2 and m.match(TWO).size() == 3
    assert m.match("SPAM").size() == m.match(None, "SPAM").size() == m.match(None, None, "SPAM").size() == m.match(attrs={"SPAM": "EGGS"}).size() == 0
    assert [r.target for r in m.match(TWO, attrs={"@lang": "no"}).df.collect()] == ["Tidevannstabell"]
    assert m.match("", [], None, {}).size() == 5 and m.match({ONE, TWO}, [DC + "title"]).size() == 3
    assert m.match_any("origin", m.df.where("target = 'Harbour office'").select("origin")).size() == 2
    assert {r.link_id for r in m.match(ONE, include_ids=False).df.collect()} == {None}
    assert m.at(1).collect()[0].target == "Harbour office" and m.where("target like 'Tide%'").size() == 3
    with pytest.raises(ValueError):
        Linkset.of(spark, [("", "r", "t")])


def test_braces(spark):
    rels = [("{o}", "r", "t"), ("o", "{r}", "t", {"{n}": "{v}"}), ("o", "r", "a/{t}"), ("o", "r", "a/{u}")]
    m = Linkset.of(spark, rels)
    assert [m.match("{o}").size(), m.match(None, "{r}").size(), m.match(None, None, "a/{t}").size(), m.match(attrs={"{n}": "{v}"}).size()] == [1] * 4
    short, table = storage.shortened(m)
    assert table.count() == 1 and full(storage.restored(short, table)) == full(m)


def test_sets_and_changes(spark):
    m = Linkset.of(spark, RELS_DC)
    more = Linkset.of(spark, [*RELS_DC[:2], ("x", "y", "z")])
    assert m.union(more).size() == 6 and m.union(more, dedup=False).size() == 8 and m.minus(more).size() == 3 and m.intersect(more).size() == 2
    assert m.union(m).equals(m) and not m.equals(more) and m.unique().size() == 5
    assert [r.target for r in m.remove([3, 0]).numbered().df.orderBy("link_id").collect()] == ["Harbour office", "Tidevannstabell", "http://one.example"]
    assert m.remove(spark.createDataFrame([(0,)], "i bigint")).size() == 4
    assert m.replace_origins({ONE: "c"}).match("c").size() == 2
    assert m.replace_origins_from(spark.createDataFrame([(ONE, "c")], "old string, new string")).match("c").size() == 2
    swapped = Linkset.of(spark, [("a", "r", "a", {"n": "a"}), ("b", "r", "a")]).replace_entity("a", "z")
    assert full(swapped) == [("b", "r", "z", ()), ("z", "r", "z", (("n", "z"),))]
    assert m.duplicate(ONE, "new", F.col("rel") == DC + "title").size() == 6
    assert m.only_rels([DC + "title"]).size() == 3 and m.without_rels([DC + "title"]).size() == 2 and m.column("rel").count() == 3
    assert Linkset.empty(spark).size() == 0 and Linkset.of(spark, [("a", "r", None)]).complete().size() == 0


def test_numbered(spark):
    many = Linkset.of(spark, [(f"o{i}", "r", str(i)) for i in range(500)])
    got = many.remove(range(0, 500, 7)).numbered().df.orderBy("link_id").collect()
    assert [r.link_id for r in got] == list(range(len(got))) and [int(r.target) for r in got] == [i for i in range(500) if i % 7]
    assert Linkset.empty(spark).numbered().size() == 0


def test_lookups_and_groups(spark):
    m = Linkset.of(spark, [("a", TYPE, "T"), ("a", LABEL, "A"), ("b", TYPE, "U"), ("b", TYPE, "T"), ("l", ITEM, "2nd"), ("l", ITEM, "1st"), ("a", "r", "x"), ("a", "r", "y", {"n": "v"})])
    assert {r.origin for r in m.origins().collect()} == {"a", "b", "l"} and {r.origin for r in m.origins("*").collect()} == {"a", "b"} and {r.origin for r in m.origins({"U"}).collect()} == {"b"}
    assert m.list_items().collect()[0].items == ["2nd", "1st"]
    assert {r.origin: r.target for r in m.match(None, TYPE).first(["origin"]).collect()} == {"a": "T", "b": "U"}
    assert m.index("r").collect()[0]["values"] == ["x", "y"] and m.index("r", True, True).count() == 1
    assert m.types("b").count() == 2 and m.labels().collect()[0].label == "A" and m.origins_of("r", "x").collect()[0].origin == "a" and m.targets("a", "r").count() == 2
    assert full(Linkset.from_nested(m.nested())) == full(m) and m.by_origin().count() == 3
    assert {tuple(r) for r in m.pivot({"r": "r", "t": TYPE}, of_types={"T"}).collect()} == {("a", "x|y", "T"), ("b", "", "T|U")}
    assert m.flatten().where("name is not null").count() == 1 and m.count().collect()[0].n_links == 8


def test_reified_hashed_refinements(spark):
    m = Linkset.of(spark, [("a", "r", "b", {"n": "v", "k": "w"}), ("c", "r", "b"), ("d", "r", "e")])
    got = m.reified()
    assert got.size() == 3 + 5 and got.flatten().where("name is not null").count() == 0
    assert {x.rel.rsplit("#")[-1]: x.target for x in got.df.where("origin like 'urn:link:%'").collect()} == {"subject": "a", "predicate": "r", "object": "b", "n": "v", "k": "w"}
    assert m.hashed().select("link_hash").distinct().count() == 3
    assert {r.broader: r.narrower for r in m.refinements("r").collect()} == {"b": ["a", "c"], "e": ["d"]}
    objects = spark.createDataFrame([('{"a":{"@value":1},"b":[{"@value":"x"},{"c":{"@value":null}}]}',), (None,)], "value string")
    assert [json.loads(r.value) if r.value else None for r in formats.unwrapped(objects).collect()] == [{"a": 1, "b": ["x", {"c": None}]}, None]


def test_graph(spark):
    rng = random.Random(1)
    edges = {(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}") for _ in range(22)}
    m = Linkset.of(spark, [(a, "to", b) for a, b in sorted(edges)] + [("n0", "other", "z")])
    want = {}
    for s in {a for a, _ in edges}:
        seen, front, d = {}, {s}, 0
        while front:
            d += 1
            front = {b for a, b in edges if a in front} - set(seen)
            seen |= dict.fromkeys(front, d)
        want |= {(s, t): d for t, d in seen.items()}
    assert {(r.origin, r.target): r.depth for r in closure(m, "to").collect()} == want
    start = spark.createDataFrame([("n0",)], "n string")
    assert {(r.origin, r.target) for r in closure(m, "to", start).collect()} == {k for k in want if k[0] == "n0"}
    two = sorted((a, d) for a, b in edges for c, d in edges if b == c)
    assert sorted(map(tuple, follow(m, ["to", "to"]).collect())) == two
    near = {"n0"} | {b for a, b in edges if a == "n0"}
    got, whole = zoom(m, start, 1)
    assert whole and triples(got) == sorted([(a, "to", b) for a, b in edges if a in near] + [("n0", "other", "z")])
    part, whole = zoom(m, start, 1, max_links=1)
    assert not whole and part.size() == 1
    assert follow_star(m, ["to", "other"]).where("origin = 'n0'").collect()[0]["other"] == ["z"]
    up = Linkset.of(spark, [("c", REFINES, "b"), ("b", REFINES, "a")])
    assert {r.origin: r.ancestors for r in ancestors(up).collect()} == {"c": ["a", "b"], "b": ["a"]}


NSES = {"P": P, "H": P + "li"}
BERGEN, STADE, KIEL = P + "bergen", P + "stade", P + "kiel"


@pytest.mark.parametrize("q,want", [
    ("?($a, P 'near', $b) and ?($b, P 'title', *)", {("a", STADE), ("b", BERGEN)}), ("?($a, P 'near', $b) and ?($b, P \"near\", $a)", {("a", BERGEN), ("b", STADE), ("a", STADE), ("b", BERGEN)}), ("?($a, P 'light', $a)", {("a", STADE)}),
    ("?($a, H 'ght', *)", {("a", STADE)}), ("?(*, P 'title', $t)", {("t", "Bergen"), ("t", "Kiel")}), ("?($a, P 'light', *) or ?($b, P 'title', 'Kiel')", {("a", STADE), ("b", KIEL)}),
    ("?($a, *, *) and not ?($a, P 'title', *)", {("a", STADE)}), ("(?($a, *, *) and ?($a, P 'title', *)) or ?($a, 'x', *)", {("a", BERGEN), ("a", KIEL)}),
])
def test_query(spark, q, want):
    m = Linkset.of(spark, PORTS)
    assert {tuple(r) for r in var_sets(m, q, NSES).collect()} == want
    if " or " not in q and " and " not in q:
        assert {tuple(r) for r in var_sets(m, q, NSES, compat=True).collect()} == want


def test_query_of_independent_sets(spark):
    m = Linkset.of(spark, PORTS)
    got = {tuple(r) for r in var_sets(m, "?($b, P 'title', *) and ?($a, P 'near', $b) and ?($c, P 'light', *)", NSES, compat=True).collect()}
    assert got == {("b", BERGEN), ("b", KIEL), ("a", STADE), ("c", STADE)}


@pytest.mark.parametrize("q", ["?($a, X 'y', *)", "?($a, *)", "$a", "f(1)", "not ?($a,*,*)", "?($a,*,*) ?", "?($a,*,*) and ?($b,*,*)", "?($a, &, *)", "?($a,*,*", "?($a,*,*) or"])
def test_query_errors(spark, q):
    with pytest.raises(QueryError):
        bindings(Linkset.of(spark, PORTS), q)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("rs"), st.sampled_from("abc")), min_size=1, max_size=12, unique=True))
def test_query_brute_force(spark, links):
    m = Linkset.of(spark, links)
    got = {tuple(r[c] for c in ("x", "y", "z")) for r in bindings(m, "?($x, 'r', $y) and ?($y, 's', $z)").collect()}
    assert got == {(a, b, d) for a, p, b in links if p == "r" for c, q, d in links if q == "s" and b == c}
    assert {r.x for r in bindings(m, "?($x, *, $x)").collect()} == {a for a, _, b in links if a == b}


def test_parse_tree():
    assert parse("?(*, 'a' 'b', $c) or ?(*,*,*) and ?(*,*,*)").parts[1].parts[0] == parse("?(*,*,*)")
    assert parse("?(*, 'a' 'b\\'', $c)").args[1].value == "ab'"


# --- hashes, IRIs, text


def test_ids():
    assert ids_of(["", "The quick brown fox jumps over the lazy dog", "spam", "eggs"]) == ["AAAAAAAAAAA", "40u8e7wHG2w", "6Xs8ixJOnDk", "jdOka-AdAMU"]
    g = IdGen("http://x/")
    assert [next(g), next(g), g.send("spam")] == ["http://x/KsnevtVGo4A", "http://x/cfu7_op7fHE", "http://x/6Xs8ixJOnDk"]
    assert ids_of(["é" * n for n in range(40)]) == [id_of("é" * n) for n in range(40)]


RFC = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "#s": "http://a/b/c/d;p?q#s", ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q", "..": "http://a/b/", "../../../g": "http://a/g", "g/./h": "http://a/b/c/g/h", "/../g": "http://a/g"}


def test_iris():
    assert all(iri.resolve(k, "http://a/b/c/d;p?q") == v for k, v in RFC.items())
    for b in ("http://a/b/c/d", "http://a/", "http://a/b/"):
        for x in ("http://a/b/c/e", "http://a/b/", "http://a/x:y", "http://z/q", "http://a/b/c/d", "http://a/b/c/d/e?q#f"):
            assert iri.resolve(iri.relativize(x, b), b) == x
    assert iri.is_reference("a/b") and not iri.is_reference("a b") and iri.is_absolute("x:y") and not iri.is_absolute("/x") and iri.percent_encode("a b%") == "a%20b%"
    with pytest.raises(ValueError):
        iri.reference("<x>")


def test_text(spark):
    df = spark.createDataFrame([("Éa  b--c!", "v12", "a; b;;"), (None, None, None), ("", "7", "")], "a string, b string, c string")
    rows = df.select(slug(F.col("a")).alias("s"), short_slug(F.col("a"), 4).alias("p"), regex_group(F.col("b"), r"v(\d)").alias("g"), replace_from(F.col("b"), [("v", "w"), ("v1", "x")]).alias("r"), split_clean(F.col("c"), ";").alias("l"), lookup(F.col("b"), {"7": "seven"}, "none").alias("m"), ifexists(F.col("a"), F.lit("y"), F.lit("n")).alias("i"), numeric_guard(F.col("b")).alias("n")).collect()
    assert tuple(rows[0]) == ("ea-b-c", "_a_b", "1", "x2", ["a", "b"], "none", "y", "v12")
    assert tuple(rows[2]) == ("", "", "7", "7", [], "seven", "n", "_7") and rows[1].s is None and rows[1].i == "n"


# --- formats

# A text that must come out exactly so.
GOLDEN = """

# http://eg.org/abc

* <http://vocab.org/uvw>: "1"
    * http://vocab.org/nop: "7"
    * http://vocab.org/qrs: "6"
* <http://vocab.org/uvw>: "3"
* <http://vocab.org/xyz>: "2"

# http://eg.org/def

* <http://vocab.org/uvw>: "1"
* <http://vocab.org/uvw>: "3"
* <http://vocab.org/xyz>: "2"
* <http://vocab.org/xyz>: "2"
    * http://vocab.org/nop: "4"
    * http://vocab.org/qrs: "5"

"""


def test_literate_golden(spark):
    v, r = "http://vocab.org/", "http://eg.org/"
    m = Linkset.of(spark, [(r + "def", v + "xyz", "2"), (r + "def", v + "xyz", "2", {v + "qrs": "5", v + "nop": "4"}), (r + "def", v + "uvw", "1"), (r + "def", v + "uvw", "3"), (r + "abc", v + "xyz", "2"), (r + "abc", v + "uvw", "1", {v + "nop": "7", v + "qrs": "6"}), (r + "abc", v + "uvw", "3")])
    assert literate.to_text(m) == GOLDEN
    assert full(literate.links_of(spark, GOLDEN)) == full(m)


def test_literate_round_trip(spark, tmp_path):
    m = Linkset.of(spark, [("http://x/a", TYPE, "http://s/T", {}, True), ("http://x/a", TYPE, "http://s/U", {}, True), ("http://x/a", "http://s/p", 'q "w" \\ \n z', {"http://s/n": "<b>"}), ("http://x/a", "http://s/p", "http://x/b", {}, True), ("http://x/b", NS + "label", "<not an iri>")])
    for b, s in ((None, None), ("http://x/", "http://s/")):
        text = literate.to_text(m, b, s)
        assert literate.links_of(spark, text).equals(m), text
        literate.write(m, str(tmp_path / f"out{bool(b)}"), b, s)
        assert literate.read(spark, str(tmp_path / f"out{bool(b)}")).equals(m)


REGISTER = """/* ports, by hand */
# @docheader

* @iri:
    * @base: http://ports.example/list/
    * @schema: http://ports.example/terms#
    * geo: http://geo.example/v
    * cur: http://money.example/coin
* @interpretations:
    * near: @resourceset
    * ruler: @resource

# <north/bergen> [Town]

* built: 1070
    * <http://ports.example/terms#by>: "Olaf"
    * sure: 'no'
* @geo/lat: 60.4
* @cur@s: "daler, \\"fine\\""
* near: stade ../list/kiel
* ruler: <.>
* motto: a line
   goes on // not a comment here
// * hidden: x
<!-- * hidden: y
* hidden: z -->
* seen: <http://else.example/?q=1#f> <!-- here -->
* @label: Bergen

## [@geo/Bay]

* depth:
"""


def test_literate_grammar():
    """Every construct of the grammar once."""
    links, doc = literate.parse(REGISTER)
    t, at, geo = "http://ports.example/terms#", "http://ports.example/list/north/bergen", "http://geo.example/v"
    got = {(x.origin, x.rel, x.target, x.is_iri, tuple(x.attrs)) for x in links}
    assert doc is None and got == {
        (at, TYPE, iri.resolve("Town", t), True, ()),
        (at, iri.resolve("built", t), "1070", False, ((t + "by", "Olaf"), (iri.resolve("sure", t), "no"))), (at, geo + "/lat", "60.4", False, ()), (at, "http://money.example/coins", 'daler, "fine"', False, ()),
        (at, iri.resolve("near", t), "http://ports.example/list/stade", True, ()), (at, iri.resolve("near", t), "http://ports.example/list/kiel", True, ()), (at, iri.resolve("ruler", t), "http://ports.example/list/", True, ()),
        (at, iri.resolve("motto", t), "a line\ngoes on // not a comment here", False, ()), (at, iri.resolve("seen", t), "http://else.example/?q=1#f", True, ()), (at, NS + "label", "Bergen", False, ()),
        (NS + "NULL", TYPE, geo + "/Bay", True, ()), (NS + "NULL", iri.resolve("depth", t), "", False, ()),
    }
    links, doc = literate.parse("# @docheader\n\n* @iri:\n    * @base: http://c/\n    * @schema: http://d/\n* @document: <sheet>\n* @language: da\n* made: 1901\n\n## lys\n\n* sted: 'ved havet'\n* tal: 7\n", autotype={2: "Fyr"})
    assert doc == "http://c/sheet" and [(x.origin, x.rel, x.target, x.attrs) for x in links] == [
        ("http://c/sheet", "http://d/made", "1901", []), ("http://c/lys", TYPE, "http://d/Fyr", []), ("http://c/lys", "http://d/sted", "ved havet", [("@lang", "da")]), ("http://c/lys", "http://d/tal", "7", []),
    ]
    two = literate.parse("# [T]\n\n* p: v\n\n# [T]\n\n* p: w\n", anonymous=True)[0]
    assert len({x.origin for x in two}) == 2


def test_templates(spark, tmp_path):
    df = spark.createDataFrame([("Q1", "2016", None), ("Q2", None, "x")], "Wikidata string, `©` string, `WD link` string")
    for t in ("# http://example.org#{Wikidata}\n\n * <http://e/c>: {%C2%A9}\n * <http://e/l>: <http://w/{WD_link}>\n", '# http://example.org#{{ Wikidata }}\n\n  * <http://e/c>: {{ _["©"] }}\n  * <http://e/l>: <http://w/{WD link}>\n'):
        assert triples(templates.ingest(df, t)) == [("http://example.org#Q1", "http://e/c", "2016"), ("http://example.org#Q2", "http://e/l", "http://w/x")]
    with pytest.raises(ValueError):
        templates.ingest(df, "# {nope}\n\n* a: b\n")
    p = tmp_path / "b.csv"
    p.write_text('Title,Author date\n"A, ""b""",1900\nC,\n', "utf-8")
    m = templates.read_csv(spark, str(p), "# http://b/{Title}\n\n* <http://d>: {Author_date}\n    * <http://n>: {Title}\n")
    assert full(m) == [('http://b/A, "b"', "http://d", "1900", (("http://n", 'A, "b"'),))]
    j = tmp_path / "b.json"
    j.write_text(json.dumps([{"title": "T", "author": {"name": "N"}}]))
    assert triples(templates.read_json(spark, str(j), "# {title}\n\n* <http://a>: {author.name}\n")) == [("T", "http://a", "N")]
    parts = list(templates.batches(df, "# {Wikidata}\n\n* <p>: v\n", F.col("Wikidata"), 3))
    assert sum(x.size() for x in parts) == 2
    doubled = templates.ingest(df, "# {Wikidata}{n}\n\n* <p>: v\n", prerow=lambda d: d.crossJoin(spark.range(2).withColumnRenamed("id", "n")))
    assert doubled.size() == 4
    templates.write_csv(m, str(tmp_path / "out"), {"d": "http://d"})
    assert spark.read.csv(str(tmp_path / "out"), header=True).collect()[0].d == "1900"


# Lines in the format's own syntax.
NT = """<http://www.w3.org/s/> <http://purl.org/dc/elements/1.1/creator> "Dave Beckett" .
<http://www.w3.org/s/> <http://purl.org/dc/elements/1.1/creator> "Art \\"B\\" \\\\ \\n" .
<http://www.w3.org/s/> <http://purl.org/dc/elements/1.1/publisher> <http://www.w3.org/> .
<http://www.w3.org/s/> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://t> .
<http://www.w3.org/s/> <http://x> "tagged"@en .
# comment
"""


def test_ntriples(spark, tmp_path):
    (tmp_path / "a.nt").write_text(NT + NT)
    m = formats.read_ntriples(spark, str(tmp_path / "a.nt"))
    assert m.size() == 4 and 'Art "B" \\ \n' in {r.target for r in m.df.collect()} and m.match(None, TYPE).size() == 1
    lines = formats.to_ntriples(m)
    assert formats.ntriples(lines).equals(m)
    assert formats.ntriples(lines, only_rel=[DC + "publisher"]).size() == 2 and formats.ntriples(lines, exclude_rel=[DC + "creator"]).size() == 2
    assert formats.ntriples(lines, disjoint=m.match(None, DC + "creator")).size() == 2
    with pytest.raises(Exception, match="blank node"):
        formats.ntriples(spark.createDataFrame([("_:a <http://x> <http://y> .",)], "value string")).size()


def test_json_dump(spark, tmp_path):
    m = Linkset.of(spark, RELS_DC)
    lines = [r.value for r in formats.to_json_lines(m).collect()]
    (tmp_path / "d.json").write_text("[" + ",".join(lines) + "]")
    (tmp_path / "e.json").write_text("\n".join(lines))
    for f in ("d.json", "e.json"):
        assert full(formats.read_json_dump(spark, str(tmp_path / f))) == full(m)
    assert formats.load_json('[["o","r","t"],["o","r","u",{"@target-type":"@iri-ref","n":"v"}]]') == [("o", "r", "t", {}, False), ("o", "r", "u", {"n": "v"}, True)]


def test_jsonld_rdfs_mermaid(spark):
    v = "http://v/"
    m = Linkset.of(spark, [("b", TYPE, v + "Book", {}, True), ("b", v + "name", "N"), ("b", v + "by", "p", {}, True), ("b", v + "by", "q", {}, True), ("p", TYPE, v + "Person", {}, True), ("p", v + "name", "P"), ("x", TYPE, v + "Only", {}, True), ("s", TYPE, v + "Skip", {}, True), ("s", v + "name", "S")])
    got = {r.origin: json.loads(r.value) for r in formats.jsonld(m, v, [v + "Skip"]).collect()}
    assert got == {"b": {"@id": "b", "@type": "Book", "name": "N", "by": ["q", {"@id": "p", "@type": "Person", "name": "P"}]}} or sorted(map(str, got["b"].pop("by"))) == sorted(map(str, [{"@id": "p", "@type": "Person", "name": "P"}, "q"])) and got == {"b": {"@id": "b", "@type": "Book", "name": "N"}}
    voc = Linkset.of(spark, [("c", TYPE, NS + "Resource"), ("p", TYPE, NS + "Property"), ("p", REFINES, "q"), ("c", REFINES, "d"), ("c", NS + "properties", "p"), ("p", NS + "value", "c"), ("p", NS + "value", NS + "Literal"), ("c", LABEL, "C"), ("c", "other", "x")])
    rd = "http://www.w3.org/2000/01/rdf-schema#"
    assert triples(formats.rdfs(voc)) == sorted([("c", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", rd + "Class"), ("p", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/1999/02/22-rdf-syntax-ns#Property"), ("p", rd + "subPropertyOf", "q"), ("c", rd + "subClassOf", "d"), ("p", rd + "domain", "c"), ("p", rd + "range", "c"), ("c", rd + "label", "C")])
    edges = sorted(r.value for r in formats.mermaid(Linkset.of(spark, [("http://a/x", "http://r/to", "http://b/x", {}, True), ("http://b/x", LABEL, "Lab"), ("http://a/x", "http://r/to", "lit")])).collect())
    assert edges == ["    x(x) -->|to| lit[\"lit\"]", "    x(x) -->|to| x_1(fa:fa-tag Lab)", "    x_1(fa:fa-tag Lab) -->|label| Lab[\"Lab\"]"]


HTML = """<body vocab="http://schema.org/" prefix="ov: http://open.vocab.org/terms/"><div typeof="Book" resource="#b"><span property="name">The <b>Big</b> Book</span><a property="url" href="/x">u</a>
<meta property="ov:n dc:d" content="7"><div property="author" typeof="Person"><span property="name">Ann</span></div><img property="image" src="i.png"></div><a href="other.html">o</a></body>"""


def test_html(spark):
    pages = spark.createDataFrame([("http://p/d/", HTML), (None, "x"), ("http://q", None)], "url string, html string")
    got = [tuple(r) for r in formats.html_links(pages).df.select("origin", "rel", "target", "target_is_iri").collect()]
    s, b = "http://schema.org/", "http://p/d/#b"
    person = next(t for o, r, t, _ in got if r == s + "author")
    assert person.startswith("_:") and set(got) == {(b, TYPE, s + "Book", True), (b, s + "name", "The Big Book", False), (b, s + "url", "http://p/x", True), (b, "http://open.vocab.org/terms/n", "7", False), (b, "http://purl.org/dc/terms/d", "7", False), (b, s + "author", person, True), (person, TYPE, s + "Person", True), (person, s + "name", "Ann", False), (b, s + "image", "http://p/d/i.png", True)}
    assert triples(formats.html_links(pages, metadata=False)) == [("http://p/d/", NS + "href", "http://p/d/other.html"), ("http://p/d/", NS + "href", "http://p/x")]


def test_atom(spark):
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>e1</id><title>T</title><author><name>A</name></author><link href="http://l"/><category term="c"/></entry><entry/></feed>'
    m = formats.atom(spark.createDataFrame([(feed,), (None,)], "value string"))
    a = "http://www.w3.org/2005/Atom#"
    assert triples(m) == sorted([("e1", TYPE, a + "entry"), ("e1", a + "title", "T"), ("e1", a + "author", "A"), ("e1", a + "link", "http://l"), ("e1", a + "category", "c")])


# --- storage


def test_storage(spark, tmp_path):
    m = Linkset.of(spark, RELS_DC)
    rel, att = storage.to_two_tables(m)
    assert (rel.count(), att.count()) == (5, 8) and full(storage.from_two_tables(rel, att)) == full(m)
    assert storage.from_two_tables(rel, None).size() == 5
    assert storage.match_two_tables(rel, att, origin=TWO, attrs={"@lang": "no"}).collect()[0].target == "Tidevannstabell"
    for by_rel in (False, True):
        storage.save(m, str(tmp_path / f"p{by_rel}"), by_rel)
        assert full(storage.load(spark, str(tmp_path / f"p{by_rel}"))) == full(m)
    plan = storage.load(spark, str(tmp_path / "pFalse")).match(TWO).df._jdf.queryExecution().toString()
    assert "PushedFilters" in plan or "pushed" in plan.lower()


def test_jdbc(spark):
    m = Linkset.of(spark, [*RELS_DC, ("a", "r", "x" * 5000)])
    url, props = "jdbc:derby:memory:links;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    storage.write_jdbc(m, url, "sp", props, mode="overwrite")
    back = storage.read_jdbc(spark, url, "sp", props, 2, (0, 10))
    assert full(back) == full(m)
    plan = back.match(TWO).df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(origin,http://two.example)" in plan and "numPartitions=2" in plan


def test_bucketed_table(spark):
    m = Linkset.of(spark, RELS_DC)
    storage.drop_table(spark, "links_test")
    storage.save_table(m, "links_test", 4)
    a = Linkset(spark.table("links_test"))
    assert full(a) == full(m)
    plan = a.df.groupBy("origin").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    storage.drop_table(spark, "links_test")


_texts = st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs", "Cc")) | st.sampled_from('\n\t"\\<>*#: '), max_size=12)
_iris = st.sampled_from(["http://x/a", "http://x/b", "http://x/c#d"])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(_iris, st.sampled_from(["http://s/p", "http://s/q"]), _texts, st.dictionaries(st.sampled_from(["http://s/m", "http://s/n"]), _texts, max_size=2)), min_size=1, max_size=6))
def test_literate_any_text(spark, links):
    m = Linkset.of(spark, links).unique()
    assert literate.links_of(spark, literate.to_text(m)).unique().equals(m)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(_iris, st.sampled_from(["r", "s"]), st.sampled_from("abc")), max_size=6), st.lists(st.tuples(_iris, st.sampled_from(["r", "s"]), st.sampled_from("abc")), max_size=6))
def test_set_laws(spark, a, b):
    x, y = (Linkset.of(spark, v) if v else Linkset.empty(spark) for v in (a, b))
    assert x.union(y).equals(y.union(x))
    assert triples(x.union(y)) == sorted(set(a) | set(b))
    assert triples(x.minus(y).unique()) == sorted(set(a) - set(b)) and triples(x.intersect(y).unique()) == sorted(set(a) & set(b))
