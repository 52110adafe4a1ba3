"""Command line: ``python -m linkframe.cli parse IN OUT``, ``transform RULES IN OUT``, ``query IN QUERY``, ``atom IN OUT``.

Formats go by extension: .vlit and .md literate, .nt N-Triples, .json dumps, .parquet tables, .html (reading) their
RDFa Lite statements, .ttl (writing) Turtle, .mmd (writing) diagrams.
"""

from __future__ import annotations

import argparse
import runpy
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkframe.operators.linkset import Linkset
from linkframe.plans.pipeline import Pipeline
from linkframe.plans.query import bindings
from linkframe.sources import formats, literate, storage


def read(spark: SparkSession, path: str) -> Linkset:
    if path == "-":
        return literate.links_of(spark, sys.stdin.read())
    ext = path.rstrip("/").rpartition(".")[2]
    if ext in ("vlit", "md", "txt"):
        return literate.read(spark, path)
    if ext == "nt":
        return formats.read_ntriples(spark, path)
    if ext == "json":
        return formats.read_json_dump(spark, path)
    if ext == "parquet":
        return storage.load(spark, path)
    if ext in ("html", "htm"):
        return formats.html_links(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html")))
    raise SystemExit(f"cannot read {path}")


def write(links: Linkset, path: str) -> None:
    ext = path.rstrip("/").rpartition(".")[2]
    if path == "-":
        sys.stdout.write(literate.to_text(links))
    elif ext in ("vlit", "md", "txt"):
        literate.write(links, path)
    elif ext == "nt":
        formats.to_ntriples(links).write.text(path)
    elif ext == "ttl":
        formats.turtle(links).select("value").write.text(path)
    elif ext == "json":
        formats.to_json_lines(links).write.text(path)
    elif ext == "mmd":
        formats.mermaid(links).write.text(path)
    elif ext == "parquet":
        storage.save(links, path)
    else:
        raise SystemExit(f"cannot write {path}")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="linkframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    for name, args in (("parse", ["input", "output"]), ("transform", ["rules", "input", "output"]), ("query", ["input", "query"]), ("atom", ["input", "output"]), ("rdfs", ["input", "output"])):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name == "transform":
            s.add_argument("--only-rel", action="append", default=[])
            s.add_argument("--exclude-rel", action="append", default=[])
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("linkframe").getOrCreate()
    if a.what == "parse":
        write(read(spark, a.input), a.output)
    elif a.what == "atom":
        write(formats.atom(spark.read.text(a.input, wholetext=True)), a.output)
    elif a.what == "rdfs":
        write(formats.rdfs(read(spark, a.input)), a.output)
    elif a.what == "query":
        rows = bindings(read(spark, a.input), a.query)
        for r in rows.select(*[F.col(c) for c in sorted(rows.columns)]).toLocalIterator():
            print("\t".join(map(str, r)))
    else:
        found = [x for x in runpy.run_path(a.rules).values() if isinstance(x, Pipeline)]
        if len(found) != 1:
            raise SystemExit("the rules file must define one Pipeline")
        links = read(spark, a.input)
        if a.only_rel:
            links = links.only_rels(a.only_rel)
        if a.exclude_rel:
            links = links.without_rels(a.exclude_rel)
        write(found[0].run(links).output, a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
