"""Links in databases: on executors that are processes of their own, with odd links, in many databases."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest
from conftest import ROOT, SF

from linkframe.operators.linkset import Linkset
from linkframe.schema import LINK_SCHEMA
from linkframe.sources import sqlite

RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__ as e
name, d, shared = sys.argv[1:]
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://" + shared).config("spark.sql.shuffle.partitions", "4").getOrCreate()
try:
    said = [list(r) for r in e.queries()[name](spark, d).collect()]
except Exception as x:
    said = str(x)
spark.stop()
print("SAID" + json.dumps(said))
"""


def on_a_cluster(name, tmp_path):
    """The query's rows on executors that share a folder and nothing else."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # the executors' logs go to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path), "PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", RUN, name, SF, str(tmp_path / "shared")], cwd=ROOT, env=env, capture_output=True, text=True, timeout=240)
    assert "SAID" in out.stdout, out.stderr[-2000:]
    said = json.loads(out.stdout.rpartition("SAID")[2])
    assert isinstance(said, list), said
    return said


def by_sql(name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("relationship", "attribute"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.execute(e.oracle_sql()[name]).fetchall()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["database_match", "database_round_trip"])
def test_executors_reach_the_databases(name, tmp_path):
    got = on_a_cluster(name, tmp_path)
    assert got and ordered(got) == ordered(by_sql(name))


ODD = [
    (None, "a", "r", "t", None, [("n", None), ("n", "v"), (None, "w")]), (7, "a", "r", None, True, []), (7, "b", "r", "it's; \x00 \"ö\"\n𝄞", False, [("", "")]),
    (1 << 62, "c", "", "", None, [("n", "v"), ("m", "v")]), (8, "d", "r", "x" * 300_000, None, [(f"n{i:05}", "y" * 20) for i in range(20_000)]),
]


@pytest.mark.parametrize("database_bytes", [1, 20_000, 4 << 20])
def test_odd_links_come_back(spark, tmp_path, database_bytes):
    given = spark.createDataFrame(ODD, LINK_SCHEMA)
    sqlite.write(Linkset(given.union(given)), path := str(tmp_path / "x"), database_bytes=database_bytes)
    back = sqlite.read(spark, path).df
    assert back.schema.simpleString() == LINK_SCHEMA.simpleString()
    assert ordered(back.collect()) == ordered(given.union(given).collect())
    ids = lambda **parts: ordered([r.origin] for r in sqlite.read(spark, path, **parts).df.collect())
    assert ids(attrs={"n": "v"}) == [("a",)] * 2 + [("c",)] * 2 and ids(attrs={"n": "v", "m": "v"}) == [("c",)] * 2 and ids(attrs={"n": None}) == []
    assert ids(origin="a", rel="r", target="t") == [("a",)] * 2 and ids(rel="r", target="") == ids(rel="r") == [(x,) for x in "aaaabbdd"] and ids(origin="A") == []
    assert ordered(sqlite.read(spark, path, attrs={"n": "v"}).df.collect()) == ordered(r for r in back.collect() if r.origin in "ac" and r.target in ("t", ""))


def test_no_links(spark, tmp_path):
    sqlite.write(Linkset.empty(spark), path := str(tmp_path / "x"))
    assert sqlite.read(spark, path).df.collect() == [] == sqlite.read(spark, path, "a", attrs={"n": "v"}).df.collect()


def test_many_databases_are_files_of_few(spark, tmp_path):
    """What a task holds is bounded: databases and the row groups that keep them are closed by size, not by rows."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    text = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 512) for k in range(8)])
    ls = Linkset.from_columns(spark.range(0, 30_000, 1, 1), F.col("id").cast("string"), F.lit("r"), text, link_id=F.col("id"))
    sqlite.write(ls, path := str(tmp_path / "x"))
    sizes = [r.n for r in spark.read.parquet(path).selectExpr("length(database) n").collect()]
    assert len(sizes) > 6 and max(sizes) < 8 << 20
    (file,) = Path(path).glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert max(meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)) < 32 << 20 and meta.num_row_groups > 1
    assert sqlite.read(spark, path).df.agg(F.sum("link_id"), F.count("target")).first()[:] == (30_000 * 29_999 // 2, 30_000)
