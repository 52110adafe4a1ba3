"""Graph-to-graph pipelines: all links that they make of small records."""

import pandas as pd
import pytest

from linkframe.functions.hashing import fingerprint_text, id_of, resource_id
from linkframe.operators.linkset import Linkset
from linkframe.plans.pipeline import COPY, Definition, Pipeline, action_template, attr, column_action, compose, contains, extra, follow, foreach, if_, ifexists, ignore, link, lookup, materialize, origin, regex_match_modify, rel, relation_action, replace_from, run_actions, stage, target, toiri, udf_action, values, var
from linkframe.schema import FINGERPRINT, LABEL, TYPE
from linkframe.sources.literate import links_of
from pyspark.sql import functions as F

V, O, SEA = "http://sea.example/v/", "http://out.example/", "http://sea.example/"
SHIPS = """# @docheader

* @iri:
    * @base: http://sea.example/
    * @schema: http://sea.example/v/

# anna [Ship]

* title: Anna
* number: HB-77
* master: Ole Brandt
* born: 1840-05-01
* home: <bergen>

# mina [Ship]

* title: Mina
* number: HB-78
* master: Ole Brandt
* born: 1840-05-01
* home: <bergen>
* home: <stade>
* toll: 12
    * coin: daler

# bergen [Port]

* title: Bergen
* flag: red

# stade [Port]

* title: Stade
"""


def port(name):
    return resource_id([(O + "name", name)], O + "Harbour")


ANNA, MINA = (resource_id([(O + "number", n)], O + "Vessel") for n in ("HB-77", "HB-78"))
OLE = resource_id([(O + "name", "Ole Brandt"), (O + "born", "1840-05-01")], O + "Person")
BY_NUMBER = {V + "Ship": materialize(O + "Vessel", fprint=[(O + "number", follow(V + "number"))])}


def master(**more):
    return materialize(
        O + "Person", O + "sailedBy", vars={"born": follow(V + "born", origin=var("input-resource"))}, fprint=[(O + "name", target()), (O + "born", var("born"))], links=[(O + "name", target()), (O + "born", var("born"))], **more
    )


def found(links):
    return {(x.origin, x.rel, x.target) for x in links.df.collect()}


def test_three_stages(spark):
    labels = {O + "Vessel": follow(O + "title"), O + "Person": follow(O + "name")}
    r = Pipeline(BY_NUMBER, {V + "title": link(rel=O + "title"), V + "master": master()}, labels).run(links_of(spark, SHIPS))
    vessels = {(ANNA, O + "title", "Anna"), (MINA, O + "title", "Mina"), (ANNA, TYPE, O + "Vessel"), (MINA, TYPE, O + "Vessel"), (ANNA, LABEL, "Anna"), (MINA, LABEL, "Mina"), (ANNA, O + "sailedBy", OLE), (MINA, O + "sailedBy", OLE)}
    assert found(r.output) == vessels | {(OLE, TYPE, O + "Person"), (OLE, O + "name", "Ole Brandt"), (OLE, O + "born", "1840-05-01"), (OLE, LABEL, "Ole Brandt")}
    assert {(x.in_rid, x.out_rid, x.is_main) for x in r.fingerprints.collect()} == {(SEA + "anna", ANNA, True), (SEA + "mina", MINA, True)}
    assert {(x.rule, x.n) for x in r.firings.collect()} == {(V + "title", 2), (V + "master", 2)}
    assert {x.rel for x in r.misses.collect()} == {TYPE, V + "number", V + "born", V + "home", V + "toll"} and r.complete
    assert {x.out_rid for x in r.entities.collect()} == {ANNA, MINA, OLE}


def test_fingerprint_is_kept_as_a_link(spark):
    model = links_of(spark, SHIPS)
    once = Pipeline(BY_NUMBER, {V + "master": master(preserve_fprint=True)}).run(model).output
    (kept,) = once.match(None, FINGERPRINT).df.collect()
    assert kept.origin == OLE and {(a.name, a.value) for a in kept.attrs} == {(O + "name", "Ole Brandt"), (O + "born", "1840-05-01"), (TYPE, O + "Person")}
    assert once.union(Pipeline(BY_NUMBER, {V + "master": master(preserve_fprint=True)}).run(model).output).equals(once)


def test_nested_entities_and_templates(spark):
    """An entity made within another knows it as @stem; the same by a template. Rules for output types see all entities of a
    resource, others its main one."""
    model = links_of(spark, SHIPS)
    voyage = dict(fprint=[(O + "of", var("of"))], links=[(O + "of", var("of")), (O + "made", var("@stem"))])
    nested = {V + "Ship": materialize(O + "Vessel", fprint=[(O + "number", follow(V + "number"))], vars={"of": follow(V + "number")}, links=[(O + "went", materialize(O + "Voyage", attach=False, **voyage))])}
    made = action_template(materialize(O + "Voyage", fprint=[(O + "of", var("of"))], links=[(O + "of", var("of")), (O + "made", var("stem"))], attach=False))
    template = {V + "Ship": materialize(O + "Vessel", fprint=[(O + "number", follow(V + "number"))], links=[(O + "went", made(of=follow(V + "number", origin=var("@stem")), stem=origin()))])}
    transform = {(V + "title", O + "Voyage", O + "Vessel"): link(rel=O + "both"), (V + "title", O + "Voyage"): link(rel=O + "voyage"), V + "title": link(rel=O + "main")}
    out = found(Pipeline(nested, transform).run(model).output)
    for ship, number, title in ((ANNA, "HB-77", "Anna"), (MINA, "HB-78", "Mina")):
        v = resource_id([(O + "of", number)], O + "Voyage")
        assert {x for x in out if x[0] in (ship, v)} == {
            (ship, TYPE, O + "Vessel"), (ship, O + "went", v), (ship, O + "both", title), (ship, O + "main", title), (v, TYPE, O + "Voyage"), (v, O + "of", number), (v, O + "made", ship), (v, O + "both", title), (v, O + "voyage", title),
        }
    again = found(Pipeline(template, transform).run(model).output)
    assert {x for x in again if x[1] in (TYPE, O + "of", O + "went")} == {x for x in out if x[1] in (TYPE, O + "of", O + "went")}


def test_references_between_output_resources(spark):
    rules = {**BY_NUMBER, V + "Port": materialize(O + "Harbour", fprint=[(O + "name", follow(V + "title"))])}
    out = Pipeline(rules, {V + "home": link(rel=O + "home", target=lookup("@resource")), V + "flag": link(rel=O + "flag")}).run(links_of(spark, SHIPS)).output
    assert {x for x in found(out) if x[1] != TYPE} == {(ANNA, O + "home", port("Bergen")), (MINA, O + "home", port("Bergen")), (MINA, O + "home", port("Stade")), (port("Bergen"), O + "flag", "red")}


def test_copies_of_chosen_resources(spark):
    model = links_of(spark, SHIPS)
    out = Pipeline({V + "Ship": if_(contains(follow(V + "home"), SEA + "stade"), materialize(COPY())), V + "Port": materialize(COPY([V + "flag"]))}).run(model).output
    assert found(out) == {x for x in found(model) if x[0] == SEA + "mina"} | {(SEA + "bergen", V + "flag", "red")}


def test_hooks_ids_and_abort(spark):
    def hook(ids):
        return Linkset.from_columns(ids, F.col("out_rid"), F.lit(O + "by"), F.lit("test"))

    r = Pipeline(BY_NUMBER, {V + "master": master()}, hooks=[hook]).run(links_of(spark, SHIPS))
    assert {x.origin for x in r.output.match(None, O + "by").df.collect()} == {ANNA, MINA, OLE}
    own = Pipeline(BY_NUMBER, {V + "title": link(rel="t")}, id_helper=lambda etype, keys, vals: F.concat(F.lit("urn:"), F.element_at(vals, 1))).run(links_of(spark, SHIPS))
    assert {x.origin for x in own.output.match(None, "t").df.collect()} == {"urn:HB-77", "urn:HB-78"}
    none = Pipeline({O + "nothing": materialize("x")}).run(links_of(spark, SHIPS))
    assert not none.complete and none.output.size() == 0


def test_known_entities_are_not_created_again(spark):
    p = Pipeline({V + "Ship": materialize(O + "Vessel", fprint=[(O + "number", follow(V + "number"))], vars={"n": follow(V + "number")}, links=[(O + "number", var("n"))])}, {V + "title": link(rel=O + "title")})
    out = found(p.run(links_of(spark, SHIPS), spark.createDataFrame([(ANNA,)], "out_rid string")).output)
    assert out == {(ANNA, O + "title", "Anna"), (MINA, O + "title", "Mina"), (MINA, TYPE, O + "Vessel"), (MINA, O + "number", "HB-78")}


def test_contexts_that_differ_by_where_a_null_is(spark):
    """Contexts (null, a) and (a, null) are two, however their values are gathered."""
    model = Linkset.of(spark, [("a", "to", "x")])
    df = spark.createDataFrame([("i", "a", None, "a", False), ("i", "a", "a", None, False)], "in_rid string, origin string, rel string, target string, target_is_iri boolean").withColumn("attrs", F.expr("cast(array() as array<struct<name:string,value:string>>)"))
    got = run_actions([(df, link(rel="r", target=values(compose(column_action(F.upper), values("v", origin())), ifexists(target(), "t", "none"))))], model)
    assert {x.target for x in got.df.collect()} == {"V", "A", "t", "none"}


@pytest.mark.parametrize("keeper,want", [
    (materialize(O + "Person", rel=O + "keeper", unique=[(O + "name", target())], links=[(O + "name", target())]), [(O + "light", O + "keeper", 0), (0, TYPE, O + "Person"), (0, O + "name", "Ida")]),
    (link(origin=materialize(O + "Person", unique=[(O + "name", target())], links=[(O + "name", target())], attach=False), rel=O + "keeps", target=origin()), [(0, O + "keeps", O + "light"), (0, TYPE, O + "Person"), (0, O + "name", "Ida")]),
])
def test_direct_actions(spark, keeper, want):
    record = {"name": "North light", "keeper": "Ida", "seen": "12"}
    links = Linkset.of(spark, [(O + "light", k, v) for k, v in record.items()])
    df = links.df.withColumn("in_rid", F.col("origin"))
    out = run_actions([(df.where(F.col("rel") == k), a) for k, a in {"name": link(rel=O + "title"), "keeper": keeper, "seen": ignore()}.items()], links)
    ida = resource_id([(O + "name", "Ida")], O + "Person")
    assert found(out) == {tuple(ida if x == 0 else x for x in w) for w in want} | {(O + "light", O + "title", "North light")}


def run_one(spark, action, links=None, t="v1", attrs=None, extras=None, base=None):
    model = Linkset.of(spark, links or [("o", "r", t, attrs or {})])
    df = model.match("o", "r").df.withColumn("in_rid", F.col("origin"))
    return sorted((x.origin, x.rel, x.target) for x in run_actions([(df, link(rel="out", target=action))], model, extras=extras, base=base).df.collect())


@pytest.mark.parametrize("action,want", [
    (values("a", target(), ["b", "c"]), {"a", "v1", "b", "c"}), (ifexists(attr("x"), "yes", "no"), {"no"}), (if_("target = 'v1'", "sql", "not"), {"sql"}), (extra("e", "d"), {"d"}), (extra("f"), {"from extras"}),
    (lookup({"v1": "mapped"}), {"mapped"}), (lookup({"v2": "x"}, onmiss="miss"), {"miss"}), (lookup({"v2": "x"}), set()), (lookup("named"), {"by name"}), (regex_match_modify(r"v(\d)"), {"1"}), (regex_match_modify(r"w(\d)"), {"v1"}),
    (replace_from([("v", "w"), ("v1", "z")]), {"z"}), (compose(column_action(F.upper), column_action(lambda c: F.concat(c, F.lit("x")))), {"V1X"}), (rel(), {"r"}), (origin(), {"o"}), (toiri("a b", "http://x/", ignore_refs=False), {"http://x/a%20b"}),
    (origin(fprint=[(TYPE, "T"), ("n", target())]), {id_of(fingerprint_text([("n", "v1")], "T"))}),
])
def test_value_actions(spark, action, want):
    got = run_one(spark, action, extras={"f": "from extras", "named": {"v1": "by name"}})
    assert {t for _, _, t in got} == want


def test_follow_split_foreach(spark):
    links = [("o", "r", "a; b ;; c"), ("o", "to", "p"), ("o", "to", "q"), ("p", "n", "P"), ("q", "n", "Q")]
    assert {t for *_, t in run_one(spark, follow("to", "n"), links)} == {"P", "Q"}
    assert {t for *_, t in run_one(spark, follow("n", origin=values("p", "q")), links)} == {"P", "Q"}
    assert {t for *_, t in run_one(spark, follow("to", action=column_action(F.upper)), links)} == {"P", "Q"}
    model = Linkset.of(spark, links)
    df = model.match("o", "r").df.withColumn("in_rid", F.col("origin"))
    out = run_actions([(df, materialize("T", "has", fprint=[("n", target())], split=";", links=[("n", target())]))], model)
    assert {x.target for x in out.match(None, "n").df.collect()} == {"a", "b", "c"} and out.match("o", "has").size() == 3
    made = run_actions([(df, foreach(target=["x", "y"], rel="z", action=link()))], model)
    assert {(x.rel, x.target) for x in made.df.collect()} == {("z", "x"), ("z", "y")}


def test_user_functions_and_relations(spark):
    assert {t for *_, t in run_one(spark, udf_action(lambda x: [x, x[::-1]]))} == {"v1", "1v"} and run_one(spark, udf_action(lambda x: None)) == []
    assert {t for *_, t in run_one(spark, regex_match_modify(r"(v)(\d)", lambda g: F.concat(g(2), g(1))))} == {"1v"}
    model = Linkset.of(spark, [("o", "r", "3"), ("o", "s", "x")])
    df = model.match("o", "r").df.withColumn("in_rid", F.col("origin"))

    def counted(frames):
        for f in frames:
            yield pd.DataFrame([(o, "n", str(i), False) for o, t in zip(f["origin"], f["target"]) for i in range(int(t))], columns=["origin", "rel", "target", "target_is_iri"])

    assert found(run_actions([(df, relation_action(counted))], model)) == {("o", "n", str(i)) for i in range(3)}
    made = run_actions([(df, foreach(target=["x", "y"], attributes={"why": values("a", target())}, rel="z", action=link(attributes={"as": attr("why")})))], model)
    assert {(x.target, tuple((a.name, a.value) for a in x.attrs)) for x in made.df.collect()} == {(t, (("as", "3"), ("as", "a"))) for t in "xy"}


def test_labels_trim_and_blank(spark):
    links = links_of(spark, SHIPS.replace("title: Anna", 'title: "  "'))
    r = Pipeline(BY_NUMBER, {V + "title": link(rel=O + "title")}, {O + "Vessel": follow(O + "title")}).run(links)
    assert {x.target for x in r.output.match(None, LABEL).df.collect()} == {"Mina"} and r.blank_labels.count() == 1


def test_same_ids_every_run_without_fingerprint(spark):
    a, b = (sorted(Pipeline({V + "Port": materialize(O + "Harbour")}).run(links_of(spark, SHIPS)).fingerprints.collect()) for _ in range(2))
    assert a == b and len(a) == 2


def test_own_stages(spark):
    class Mine(Definition):
        @stage(2)
        def second(self):
            self.output = self.output.union(Linkset.of(spark, [("b", "r", "2")]))
            return False

        @stage(1)
        def first(self):
            self.output = self.output.union(self.model.match("a"))

        @stage(3)
        def never(self):
            raise AssertionError

    out = Mine().run(Linkset.of(spark, [("a", "r", "1"), ("x", "r", "0")]))
    assert {x.target for x in out.df.collect()} == {"1", "2"}
