"""Mixing sources to target weights by entropy balancing.

Of all rates that give every source its share of the tokens, those that differ least (in relative entropy) from using
each document once are exponentially tilted ones, ``min(max_repeats, exp(lambda_source * tokens / mean))``. The lambdas
solve a convex dual by Newton's method, each step one distributed sum over the documents. The rates are then rounded
to whole copies so that the tokens of every source still meet their target.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkframe.llm.encoding import VOCABULARY, count_tokens
from linkframe.schema import cut

#: The targets are parameters of the mix; more of them than this are refused rather than gathered.
MOST_SOURCES = 10_000
BINS = 256


@dataclass
class Target:
    weight: float
    repeats: int
    tokens: int = 0
    docs: int = 0
    goal: float = 0.0
    tilt: float = 0.0
    lo: float = -math.inf
    hi: float = math.inf

    @property
    def cap(self) -> int:
        return self.repeats * self.tokens


def read_targets(targets: DataFrame) -> dict[str, Target]:
    rows = targets.select("source", "weight", "max_repeats").where("source is not null").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    out: dict[str, Target] = {}
    for r in rows:
        if r.source in out:
            raise ValueError(f"two targets for {r.source!r}")
        out[r.source] = Target(max(0.0, float(r.weight or 0.0)), 1 if r.max_repeats is None else max(0, int(r.max_repeats)))
    return out


def _with(docs: DataFrame, t: dict[str, Target], **values: Callable[[str, Target], float]) -> DataFrame:
    """``docs`` of the sources ``t`` with a column of each of the values. The sources are at most MOST_SOURCES, so their table is
    broadcast."""
    rows = [(s, *[float(v(s, x)) for v in values.values()]) for s, x in t.items()]
    table = docs.sparkSession.createDataFrame(rows, "source string, " + ", ".join(f"{c} double" for c in values))
    return docs.join(F.broadcast(table), "source")


def _rated(docs: DataFrame, t: dict[str, Target]) -> DataFrame:
    """With ``cap``, ``z`` (size against the mean of the source) and ``r``, the rate."""
    docs = _with(docs, t, cap=lambda _, x: x.repeats, mean=lambda _, x: max(1.0, x.tokens / max(1, x.docs)), tilt=lambda _, x: x.tilt)
    z = F.col("n_tokens") / F.col("mean")
    return docs.withColumns({"z": z, "r": F.least("cap", F.exp(F.least(F.col("tilt") * z, F.lit(60.0))))}).drop("mean", "tilt")


def balance(docs: DataFrame, t: dict[str, Target], close: float = 1e-9) -> int:
    """Set the tilts; gives the rounds it took. ``docs``: source, n_tokens. The dual falls apart by source, so the Hessian is
    diagonal; a step that leaves the bracket of its source is replaced by bisection. A source is done when its tokens are
    within ``close`` of the goal, or no number is left between the ends of its bracket, so it always ends, and never before."""
    open_, rounds = {}, 0
    for s, x in t.items():
        if x.goal >= x.cap * (1 - 1e-12):
            x.tilt = 1e6  # every document as often as is allowed
        else:
            open_[s] = x
    while open_:
        rounds += 1
        n = F.col("n_tokens")
        sums = _rated(docs, open_).groupBy("source").agg(F.sum(n * F.col("r")).alias("g"), F.sum(F.when(F.col("r") < F.col("cap"), n * F.col("z") * F.col("r")).otherwise(0.0)).alias("h"))
        for row in sums.collect():
            x = open_[row.source]
            gap = row.g - x.goal
            if abs(gap) <= close * max(1.0, x.goal):
                del open_[row.source]
                continue
            x.lo, x.hi = (x.tilt, x.hi) if gap < 0 else (x.lo, x.tilt)
            step = x.tilt - gap / row.h if row.h > 0 else math.nan
            if not x.lo < step < x.hi:
                step = (x.lo + x.hi) / 2 if math.isfinite(x.lo + x.hi) else (x.lo * 2 + 1 if math.isfinite(x.lo) else x.hi * 2 - 1)
            if not x.lo < step < x.hi:
                del open_[row.source]
                continue
            x.tilt = step
    return rounds


def _thresholds(docs: DataFrame, t: dict[str, Target]) -> dict[str, float]:
    """Below which value of ``g`` a document gets its extra copy, so that the tokens of the source meet their goal to the size
    of a document: by histograms, each a finer view of the bin in which the goal lies, until that bin holds one document (or
    is as narrow as the hashes that ``g`` is made of are apart)."""
    lo, width, need = {s: -1.0 for s in t}, 2.0, {}
    for r in docs.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("whole")).alias("n")).collect():
        need[r.source] = t[r.source].goal - r.n
    best, open_ = dict.fromkeys(t, -1.0), {s: x for s, x in t.items() if s in need}
    while open_ and width > 2.0**-41:
        step = width / BINS
        looked = _with(docs.where("spare"), open_, lo=lambda s, _: lo[s]).withColumn("bin", F.floor((F.col("g") - F.col("lo")) / step).cast("int"))
        bins = looked.where((F.col("bin") >= 0) & (F.col("bin") < BINS)).groupBy("source", "bin").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("d"))
        per: dict[str, dict[int, tuple[int, int]]] = {}
        for r in bins.collect():
            per.setdefault(r.source, {})[r.bin] = (r.n, r.d)
        for s in list(open_):
            got = 0
            for i in range(BINS):
                n, d = per.get(s, {}).get(i, (0, 0))
                if got + n > need[s]:
                    # the goal lies in this bin: the nearer of its two ends for now, and a finer look
                    best[s] = lo[s] + (i + 1) * step if got + n - need[s] < need[s] - got else lo[s] + i * step
                    lo[s] += i * step
                    need[s] -= got
                    if d <= 1:
                        del open_[s]
                    break
                got += n
            else:  # all that can be had is not too much
                best[s] = lo[s] + width
                del open_[s]
        width = step
    return best


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(documents, shares): how often each document of the wished sources is used (id, source, n_tokens, rate, n_copies),
    and per wished source its weight, tokens, share, n_docs and most_copies.

    The size of the mix is the largest at which every source that has any tokens can have its weight with none of its
    documents used more than ``max_repeats`` times, or ``total_tokens`` where that is smaller. A source without documents
    or tokens has share 0, and the others keep their proportions. Documents of null or unwished sources and those without
    tokens (null, empty) are used 0 times; the former do not come out. ``max_repeats`` null is 1, a weight null or below 0
    is 0; two targets for one source are an error. Repeated ids count as documents each. Which documents get the extra
    copy is decided by a hash of the id: the same input gives the same mix.
    """
    t = read_targets(targets)
    wished = targets.select(F.col("source").alias("_wished")).where("source is not null")
    wanted = documents.join(F.broadcast(wished), F.col(source_col) == F.col("_wished"), "left_semi")  # at most MOST_SOURCES
    rows = count_tokens(wanted.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.col(text_col).alias("_text")), ["_id", "source"], "_text", vocabulary)
    rows = cut(rows)
    for r in rows.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("d")).collect():
        t[r.source].tokens, t[r.source].docs = r.n, r.d
    able = {s: x for s, x in t.items() if x.cap > 0 and x.weight > 0}
    all_weight = sum(x.weight for x in able.values())
    size = min((x.cap * all_weight / x.weight for x in able.values()), default=0.0)
    size = min(size, float(total_tokens)) if total_tokens is not None else size
    for x in able.values():
        x.goal = min(float(x.cap), size * x.weight / all_weight)
    unused = [F.lit(0.0).alias("rate"), F.lit(0).cast("bigint").alias("n_copies")]
    if able:
        used = rows.where("n_tokens > 0")
        balance(used, able)
        used = _rated(used, able).withColumn("whole", F.floor("r").cast("bigint"))
        u = F.pmod(F.xxhash64(F.col("_id"), F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
        used = used.withColumn("g", u - (F.col("r") - F.col("whole"))).withColumn("spare", F.col("whole") + 1 <= F.col("cap"))
        below = _thresholds(used, able)
        used = _with(used, able, below=lambda s, _: below[s])
        extra = F.when(F.col("spare") & (F.col("g") < F.col("below")), 1).otherwise(0)
        used = used.select("_id", "source", "n_tokens", F.col("r").alias("rate"), (F.col("whole") + extra).alias("n_copies"))
        names = documents.sparkSession.createDataFrame([(s,) for s in able], "_able string")
        rest = rows.join(F.broadcast(names), (F.col("source") == F.col("_able")) & (F.col("n_tokens") > 0), "left_anti")
        out = used.unionByName(rest.select("_id", "source", "n_tokens", *unused))
    else:
        out = rows.select("_id", "source", "n_tokens", *unused)
    sums = out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens"), F.count_if(F.col("n_copies") > 0).alias("n_docs"), F.max("n_copies").alias("most_copies"))
    total = sums.agg(F.sum("tokens")).scalar()
    shares = targets.where("source is not null").select("source", "weight", "max_repeats").join(sums, "source", "left")
    shares = shares.select("source", "weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("share"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    return out.withColumnRenamed("_id", id_col), shares
