"""Streams run to completion against the same in batch; the command line end to end."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from linkframe import cli
from linkframe.operators.linkset import Linkset
from linkframe.plans.pipeline import Pipeline, follow, link, materialize
from linkframe.schema import TYPE
from linkframe.sources import storage
from linkframe.streaming import read_links, read_ntriples, run_pipeline, sessions, to_completion, unseen, window_counts

T0 = datetime(2024, 1, 1)


def events(spark, path, minutes):
    rows = [(T0 + timedelta(minutes=m), k) for m, k in minutes]
    spark.createDataFrame(rows, "at timestamp, k string").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("at timestamp, k string").parquet(path)


def test_windows_sessions_unseen(spark, tmp_path):
    s = events(spark, str(tmp_path / "e"), [(1, "a"), (2, "a"), (61, "a"), (62, "b"), (300, "z")])
    got = to_completion(window_counts(s, "at", ["k"], "1 hour", "10 minutes"), str(tmp_path / "o"), str(tmp_path / "c")).collect()
    assert {(r.start, r.k): r.n for r in got} == {(T0, "a"): 2, (T0 + timedelta(hours=1), "a"): 1, (T0 + timedelta(hours=1), "b"): 1}
    got = to_completion(sessions(s, "at", ["k"], "30 minutes", "10 minutes"), str(tmp_path / "o2"), str(tmp_path / "c2")).collect()
    assert sorted((r.k, r.n) for r in got) == [("a", 1), ("a", 2), ("b", 1)]
    assert to_completion(unseen(s, "at", "1 day", ["k"]), str(tmp_path / "o3"), str(tmp_path / "c3")).count() == 3


def test_ntriples_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.nt").write_text('<a> <p> "x" .\n<a> <p> "x" .\n<a> <q> <b> .\n')
    df = read_ntriples(spark, str(tmp_path / "in"), only_rel=["p"]).df
    assert to_completion(df, str(tmp_path / "o"), str(tmp_path / "c")).count() == 2


def test_incremental_pipeline(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    p = Pipeline({"T": materialize("U", fprint=[("n", follow("name"))])}, {"name": link(rel="n")})
    for n, (rid, name) in enumerate([("x", "N"), ("y", "N"), ("z", "M")]):
        Linkset.of(spark, [(rid, TYPE, "T"), (rid, "name", name)]).df.write.mode("append").parquet(src)
        run_pipeline(read_links(spark, src), p, out, str(tmp_path / "c")).awaitTermination()
        made = spark.read.parquet(out + "/links").where(F.col("rel") == "n")
        assert made.select("target").distinct().count() == made.count() == (1 if n < 2 else 2)


def test_incremental_pipeline_is_one_run(spark, tmp_path):
    """New facts about an entity that is known are not lost: two batches give what one run over both does."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    p = Pipeline({"T": materialize("U", fprint=[("n", follow("name"))], links=[("own", "o")])}, {"name": link(rel="n"), ("born", "U"): link(rel="b")}, {"U": follow("n")})
    batches = [[("x", TYPE, "T"), ("x", "name", "N")], [("y", TYPE, "T"), ("y", "name", "N"), ("y", "born", "1970")], [("z", TYPE, "T"), ("z", "name", "M")]]
    for b in batches:
        Linkset.of(spark, b).df.write.mode("append").parquet(src)
        run_pipeline(read_links(spark, src), p, out, str(tmp_path / "c")).awaitTermination()
    cols = ["origin", "rel", "target"]
    made = sorted(map(tuple, spark.read.parquet(out + "/links").select(*cols).collect()))
    whole = p.run(Linkset.of(spark, [x for b in batches for x in b])).output
    assert made == sorted(map(tuple, whole.df.select(*cols).collect())) and [t for _, r, t in made if r == "b"] == ["1970"]
    assert spark.read.parquet(out + "/ids").count() == 2


def test_cli(spark, tmp_path, capsys):
    src = tmp_path / "in.vlit"
    src.write_text("# http://a [http://T]\n\n* <http://name>: N\n")
    for ext in ("nt", "json", "vlit", "parquet", "mmd"):
        assert cli.main(["parse", str(src), str(tmp_path / f"o.{ext}")]) == 0
        if ext != "mmd":
            assert cli.read(spark, str(tmp_path / f"o.{ext}")).size() == 2
    cli.main(["query", str(src), "?($a, 'http://name', $n)"])
    assert capsys.readouterr().out.strip() == "http://a\tN"
    rules = tmp_path / "rules.py"
    rules.write_text("from linkframe.plans.pipeline import *\nRULES = Pipeline({'http://T': materialize(COPY())})\n")
    cli.main(["transform", str(rules), str(src), str(tmp_path / "t.parquet"), "--exclude-rel", "http://name"])
    assert storage.load(spark, str(tmp_path / "t.parquet")).size() == 1
