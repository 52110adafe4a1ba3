"""Frequent keys, orphan references and wide tables against brute force, with the awkward inputs of each."""

from collections import defaultdict
from datetime import date, datetime
from decimal import Decimal

import pytest

from linkframe.functions.canon import canon
from linkframe.operators.orphans import orphan_references
from linkframe.operators.tree_agg import frequent_keys, key_stats
from linkframe.operators.widen import Term, canon_text, eav_to_wide, read_terms
from linkframe.queries_pipeline import p5_wide
from linkframe.schema import table

SF = "/root/testdata/sf0.001"
LINKS = "rawid bigint, origin string, rel string, target string, recorded_at timestamp_ntz, deleted_at timestamp_ntz, extra string"
ATTRS = "attr_id bigint, rawid bigint, name string, value string, recorded_at timestamp_ntz, _value string"
T0, T1, T2 = datetime(2022, 1, 1), datetime(2022, 2, 1), datetime(2022, 3, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_key_stats_brute_force(spark):
    links = table(spark, SF, "relationship")
    want = defaultdict(lambda: [0, set(), set(), (datetime.min, -1)])
    for r in links.collect():
        w = want[r.rel]
        w[0] += 1
        w[1].add(r.origin)
        w[2].add(r.target)
        w[3] = max(w[3], (r.recorded_at, r.rawid))
    got = {r.rel: r for r in key_stats(links, fan_in=2).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        assert (got[k].n_rows, got[k].n_origins, got[k].n_targets, got[k].latest_rawid) == (w[0], len(w[1]), len(w[2]), w[3][1])


def test_key_stats_nulls_ties_empty(spark):
    data = [(1, "a", None, "x", T0, None, "e"), (2, None, None, None, T0, None, "e"), (3, "a", "", "x", None, None, None), (4, "a", "", "y" * 100_000, T1, None, None), (4, "a", "", "x", T1, None, None)]
    got = {r.rel: tuple(r)[1:] for r in key_stats(spark.createDataFrame(data, LINKS)).collect()}
    assert got == {None: (2, 1, 1, 2, None, None), "": (3, 1, 2, 4, "a", "y" * 100_000)}
    assert key_stats(spark.createDataFrame([], LINKS)).count() == 0
    assert frequent_keys(spark.createDataFrame([], LINKS), 0.06).count() == 0
    assert rows(frequent_keys(spark.createDataFrame(data, LINKS), 0.6).select("rel")) == [("",)]
    with pytest.raises(ValueError):
        key_stats(spark.createDataFrame(data, LINKS), fan_in=1)


@pytest.mark.parametrize("match,want", [("simple", [1, 6]), ("full", [1, 2, 3, 6]), ("partial", [1, 3, 6])])
def test_orphans_null_masks(spark, match, want):
    keys = spark.createDataFrame([("a", 1, T0, None), ("a", 1, T0, None), ("b", 2, T0, T1), (None, 3, T0, None)], "k string, n int, s timestamp_ntz, e timestamp_ntz")
    refs = spark.createDataFrame(
        [(1, "a", 2, T1, "x"), (2, "a", None, T1, "x"), (3, None, 9, T1, "x"), (4, None, None, T1, "x"), (5, "a", 1, T0, "x"), (6, "b", 2, T1, "x"), (7, "b", 2, T0, "x")],
        "id int, x string, y int, at timestamp_ntz, k string",
    )
    got = orphan_references(refs, keys, ["x", "y"], ["k", "n"], "at", "s", "e", match)
    assert sorted(r.id for r in got.collect()) == want


def test_orphans_edges(spark):
    keys = spark.createDataFrame([("a", T0, T1), ("a", T2, None), ("b", None, None)], "k string, s timestamp_ntz, e timestamp_ntz")
    refs = spark.createDataFrame([(1, "a", T0), (2, "a", T1), (3, "a", T2), (4, "a", None), (5, "b", T1), (6, "a", T1), (6, "a", T1)], "id int, k string, at timestamp_ntz")
    run = lambda r, k: sorted(x.id for x in orphan_references(r, k, ["k"], ["k"], "at", "s", "e").collect())
    assert run(refs, keys) == [2, 4, 5, 6, 6]
    assert run(refs, keys.limit(0)) == [1, 2, 3, 4, 5, 6, 6]
    assert run(refs.limit(0), keys) == []
    with pytest.raises(ValueError):
        orphan_references(refs, keys, ["k"], ["k"], "at", "s", "e", "loose")


TERMS = [Term("n", "rel", "num", "integer", False), Term("d", "rel", "day", "date", False), Term("ok", "rel", "ok", "boolean", False), Term("m", "rel", "many", "string", True), Term("i", "rel", "ints", "integer", True), Term("c", "attr", "kind", "decimal", False)]


def test_wide_small(spark):
    links = [
        (1, "A", "n", " +1,234 ", T0, None, "x"), (2, "a.", "N", "7", T1, None, "x"), (3, "A", "n", "8", T1, None, "x"), (4, "A", "n", "9", T2, T2, "x"), (5, "A", "n", "l2", T2, T2, "x"),
        (6, "B", "d", "31.02.2020", T0, None, "x"), (7, "B", "d", "29 February 2020", T0, None, "x"), (8, "B", "ok", " YES", T0, None, "x"), (9, "B", "n", "9" * 40, T0, None, "x"),
        (10, "B", "m", "z", T0, None, "x"), (11, "B", "m", "z", T1, None, "x"), (12, "B", "m", "", T1, None, "x"), (13, "B", "i", "1,000", T1, None, "x"), (14, "B", "i", "1000", T1, None, "x"), (15, "B", "i", "5", None, None, "x"),
        (16, "C", "undeclared", "v", T0, None, "x"), (17, None, "n", "bad", T0, None, "x"), (18, "C", None, "v", T0, None, "x"), (19, "C", "n", None, T0, None, "x"), (20, "C", "n", " ", T0, None, "x"),
    ]
    attrs = [(1, 1, "c", "1.50", T0, "x"), (2, None, "c", "1.x", T0, "x"), (3, 99, "c", "2", T0, "x"), (4, 4, "c", "3", T2, "x"), (5, 1, None, "1", T0, "x"), (6, 1, "c", None, T2, "x")]
    wide = eav_to_wide(spark.createDataFrame(links, LINKS), spark.createDataFrame(attrs, ATTRS), TERMS).collect()
    got = {r.entity: r for r in wide if r.kind == "row"}
    assert set(got) == {"A", "B", "C"}
    a, b, c = got["A"], got["B"], got["C"]
    assert (a.num, a["w_kind"], a.many) == (Decimal(8), Decimal("1.5"), None)
    assert (b.day, b.ok, b.many, b.ints, b.num) == (date(2020, 2, 29), True, ["", "z"], [Decimal(5), Decimal(1000)], None)
    assert [c[t.column if t.column != "kind" else "w_kind"] for t in TERMS] == [None] * 6
    reports = sorted((r.kind, r.src_table, r.row_id, r.column, r.value) for r in wide if r.kind != "row")
    assert reports == [("too_long", "relationship", 9, "num", "9" * 40), ("unread", "attribute", 2, "kind", "1.x"), ("unread", "relationship", 5, "num", "l2"), ("unread", "relationship", 6, "day", "31.02.2020"), ("unread", "relationship", 17, "num", "bad"), ("unread", "relationship", 20, "num", " ")]
    assert len({r.ordinal for r in wide if r.kind == "row"}) == 3


LARGE = [(i, "A", "m", f"v{i % 40}", T0, None, "x") for i in range(60)] + [(100 + i, "A", "n", str(i), datetime(2022, 1, 1 + i), None, "x") for i in range(9)] + [(200, "B", "m", "w", T0, None, "x"), (300, "A", "i", "5", T0, None, "x"), (301, "A", "i", "4", T0, None, "x")]


@pytest.mark.parametrize("hot_rows", [1, 20, 10**9])
def test_wide_hot_entities_change_nothing(spark, hot_rows):
    attrs = spark.createDataFrame([(i, 5, "c", str(i), datetime(2022, 1, 1 + i), "x") for i in range(25)], ATTRS)
    wide = eav_to_wide(spark.createDataFrame(LARGE, LINKS), attrs, TERMS, hot_rows=hot_rows).collect()
    got = {r.entity: r for r in wide}
    assert len(wide) == 2 and got["A"].many == sorted(f"v{i}" for i in range(40)) and got["A"].num == 8 and got["A"]["w_kind"] == 24 and got["B"].many == ["w"] and got["A"].ints == [Decimal(4), Decimal(5)]
    assert eav_to_wide(spark.createDataFrame([], LINKS), attrs, TERMS, hot_rows=hot_rows).where("kind = 'row'").count() == 0


def test_wide_lists_beyond_a_cell_stand_beside(spark):
    wide = eav_to_wide(spark.createDataFrame(LARGE, LINKS), spark.createDataFrame([], ATTRS), TERMS, cell_bytes=100, hot_rows=20).collect()
    got = {r.entity: r for r in wide if r.kind == "row"}
    assert got["A"].many is None and got["A"].ints == [Decimal(4), Decimal(5)] and got["B"].many == ["w"]
    assert sorted(r.value for r in wide if r.kind == "more") == sorted(f"v{i}" for i in range(40)) and {(r.entity, r.column) for r in wide if r.kind == "more"} == {("A", "many")}


def test_ordinals_are_unique_and_ranges_whole(spark):
    links = [(i, f"e{i % 700}", "n", str(i), T0, None, "x") for i in range(1400)]
    parts = eav_to_wide(spark.createDataFrame(links, LINKS), spark.createDataFrame([], ATTRS), TERMS, span=16).selectExpr("ordinal", "spark_partition_id() as p").collect()
    assert len({r.ordinal for r in parts}) == len(parts) == 700
    assert len({(r.ordinal // 16, r.p) for r in parts}) == len({r.ordinal // 16 for r in parts})


def test_terms_share_a_column(spark):
    voc = "term string, term_kind string, col_name string, value_type string, is_multi boolean"
    terms = read_terms(spark.createDataFrame([("n", "rel", "num", "integer", False), ("nn", "rel", "num", "integer", False), ("c", "attr", "num", "integer", False)], voc))
    links = [(1, "A", "n", "1", T0, None, "x"), (2, "A", "nn", "2", T1, None, "x"), (3, "B", "nn", "5", T0, None, "x"), (4, "C", "n", "6", T0, None, "x")]
    got = eav_to_wide(spark.createDataFrame(links, LINKS), spark.createDataFrame([(1, 4, "c", "7", T2, "x")], ATTRS), terms).collect()
    assert {r.entity: r.num for r in got} == {"A": 2, "B": 5, "C": 7}
    with pytest.raises(ValueError):
        eav_to_wide(spark.createDataFrame(links, LINKS), spark.createDataFrame([], ATTRS), [*terms, Term("x", "rel", "num", "string", False)])


def test_p5_wide_has_every_value(spark, tmp_path):
    links = [(i, "A", "m", f"v{i}", T0, None, "x") for i in range(1001)] + [(2000, "A", "i", "5", T0, None, "x"), (2001, "B", "m", "w", T0, None, "x")]
    tables = {"relationship": spark.createDataFrame(links, LINKS), "attribute": spark.createDataFrame([], ATTRS)}
    tables["vocabulary"] = spark.createDataFrame([(t.term, t.kind, t.column, t.type, t.multi) for t in TERMS], "term string, term_kind string, col_name string, value_type string, is_multi boolean")
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.entity: r for r in p5_wide(spark, str(tmp_path)).collect()}
    assert set(got) == {"A", "B"} and got["A"].ints == "5" and got["B"].many == "w"
    assert got["A"].many == "|".join(sorted(f"v{i}" for i in range(1001)))


def test_wide_brute_force(spark):
    links, attrs, terms = table(spark, SF, "relationship"), table(spark, SF, "attribute"), read_terms(table(spark, SF, "vocabulary"))
    wide = {r.entity: r for r in eav_to_wide(links, attrs, terms).where("kind = 'row'").collect()}
    by = {canon_text(t.term): t for t in terms if t.kind == "rel"}
    names, many, one = defaultdict(set), defaultdict(set), {}
    for r in links.collect():
        k = canon_text(r.origin)
        names[k].add(r.origin)
        t = by.get(canon_text(r.rel))
        if t is None or r.deleted_at or t.type not in ("string", "iri"):
            continue
        if t.multi:
            many[k, t.column].add(r.target)
        else:
            one[k, t.column] = max(one.get((k, t.column), (datetime.min, "")), (r.recorded_at, r.target))
    assert len(wide) == len(names)
    for k, spelled in names.items():
        r = wide[max(spelled, key=lambda s: (-len(s), s))]
        for t in by.values():
            if t.type in ("string", "iri"):
                assert r[t.column] == (sorted(many[k, t.column]) or None if t.multi else one.get((k, t.column), (0, None))[1]), (k, t)


def test_canon(spark):
    data = [(" <Http://A.b/C> ", "httpabc"), ("STRASSE-ß", "strassess"), ("…«»—_`^~|", ""), (None, None), ("", "")]
    got = spark.createDataFrame(data, "s string, w string").select(canon("s").alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)
    assert [canon_text(s) for s, _ in data if s is not None] == [w for s, w in data if s is not None]


def test_canon_of_every_ascii_character(spark):
    data = [(f"{chr(i)}A{chr(i)}{tail}", i) for i in range(1, 128) for tail in ("", "é")]
    got = spark.createDataFrame(data, "s string, i int").select("s", canon("s").alias("g")).collect()
    assert all(r.g == canon_text(r.s) for r in got)
