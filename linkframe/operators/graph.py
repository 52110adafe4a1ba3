"""Paths through links: multi-hop following, closure, neighbourhoods, ancestors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkframe.operators.linkset import Linkset
from linkframe.schema import REFINES, cut


def follow(links: Linkset, rels: Sequence[str], origins: DataFrame | None = None, origin_col: str = "origin") -> DataFrame:
    """(origin, target): all ends of the path along ``rels``, as often as there are ways. A chain of equi-joins; an origin
    with a large part of the links is split by adaptive skew handling."""
    if not rels:
        raise ValueError("a path needs a rel")
    hop = links.match(None, rels[0]).df.select("origin", "target")
    if origins is not None:
        hop = hop.join(origins.select(F.col(origin_col).alias("_o")).distinct(), F.col("origin") == F.col("_o"), "left_semi")
    for r in rels[1:]:
        nxt = links.match(None, r).df.select(F.col("origin").alias("_via"), F.col("target").alias("_end"))
        hop = hop.join(nxt, F.col("target") == F.col("_via")).select("origin", F.col("_end").alias("target"))
    return hop


def follow_star(links: Linkset, rels: Iterable[str]) -> DataFrame:
    """(origin, one array column per rel): several one-step paths from the same origins as one conditional aggregation."""
    rels = list(rels)
    kept = links.match(None, rels).df
    return kept.groupBy("origin").agg(*[F.array_sort(F.collect_list(F.when(F.col("rel") == r, F.col("target")))).alias(r) for r in rels])


def closure(links: Linkset, rel: str | Sequence[str], starts: DataFrame | None = None, most_depth: int = 1000) -> DataFrame:
    """(origin, target, depth): everything reachable along ``rel``, with the least number of steps. Each round extends the
    newest pairs only and takes out those known already, so cycles end; rounds are written tables."""
    edges = cut(links.match(None, rel).df.select("origin", "target").where("target is not null").distinct())
    new = edges if starts is None else edges.join(starts.select(F.col(starts.columns[0]).alias("_s")).distinct(), F.col("origin") == F.col("_s"), "left_semi")
    new = cut(new.withColumn("depth", F.lit(1)))
    found = new
    for depth in range(2, most_depth + 1):
        step = new.select("origin", F.col("target").alias("_via")).join(edges.select(F.col("origin").alias("_via"), "target"), "_via").select("origin", "target").distinct()
        new = cut(step.join(found.select("origin", "target"), ["origin", "target"], "left_anti").withColumn("depth", F.lit(depth)))
        if not new.limit(1).count():
            return found
        found = found.unionByName(new)
    raise RuntimeError(f"more than {most_depth} steps")


def zoom(links: Linkset, focus: DataFrame, depth: int = 1, max_links: int | None = None) -> tuple[Linkset, bool]:
    """The links of the focus and, ``depth`` more times, those of their targets; and whether all are there. With
    ``max_links`` the nearest that many, by steps and then by id. Links are looked at once, however they are reached."""
    seen = cut(focus.select(F.col(focus.columns[0]).alias("node")).where("node is not null").distinct().withColumn("step", F.lit(0)))
    new = seen
    for step in range(1, depth + 1):
        reached = links.df.join(new.select("node"), F.col("origin") == F.col("node"), "left_semi").select(F.col("target").alias("node")).where("node is not null").distinct()
        new = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("step", F.lit(step)))
        seen = seen.unionByName(new)
    out = links.df.join(seen.select(F.col("node").alias("_n"), "step"), F.col("origin") == F.col("_n")).drop("_n")
    if max_links is None:
        return Linkset(out.drop("step")), True
    n = out.limit(max_links + 1).count()
    return Linkset(out.orderBy("step", "link_id").limit(max_links).drop("step")), n <= max_links


def ancestors(links: Linkset, rel: str = REFINES) -> DataFrame:
    """(origin, ancestors): everything above an origin, the farthest first."""
    up = closure(links, rel)
    return up.groupBy("origin").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("depth"), "target"))), lambda x: x.target).alias("ancestors"))
