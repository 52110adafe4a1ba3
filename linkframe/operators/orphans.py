"""References to records that do not exist, or not at the time of the reference.

Composite keys with partial nulls: the references are grouped by their null mask, and each mask is anti-joined on its
columns that are not null, under the declared match semantics (those of SQL's MATCH clause).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "full", "partial")


def live_spans(keys: DataFrame, key_cols: Sequence[str], start: str, end: str) -> DataFrame:
    """(key columns, _from, _to): repeated rows of a key collapse before anything is joined; of the rows that begin at
    the same moment the longest stays. ``_to`` null means still live. Rows without a beginning are never live."""
    spans = keys.where(F.col(start).isNotNull()).groupBy(*[F.col(c).alias(c) for c in key_cols], F.col(start).alias("_from"))
    merged = spans.agg(F.max(end).alias("_to"), F.max(F.col(end).isNull()).alias("_open"))
    return merged.select(*key_cols, "_from", F.when(~F.col("_open"), F.col("_to")).alias("_to"))


def orphan_references(refs: DataFrame, keys: DataFrame, ref_cols: Sequence[str], key_cols: Sequence[str], at: str, start: str, end: str, match: str = "simple") -> DataFrame:
    """Rows of ``refs`` whose key is not live in ``keys`` at the row's time ``at``; live is start <= at < end, and a
    null end is never over.

    Match semantics of a reference in which some of several columns are null: 'simple' - it refers to nothing, so it
    is no orphan; 'full' - it is an orphan always; 'partial' - it is one if no live key agrees in the other columns.
    A reference of only nulls refers to nothing. A reference without a time finds nothing live and is an orphan. An
    empty ``keys`` makes every reference an orphan. Repeated references come out as often as they stand there.

    A key that many references share is split by adaptive skew handling (the reference side of an anti-join can be
    split freely), and the key side has one row per key and beginning.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    if len(ref_cols) != len(key_cols) or not 1 <= len(ref_cols) <= 8:
        raise ValueError("1 to 8 columns, as many on either side")
    sides, out = [f"_k{i}" for i in range(len(key_cols))], None
    spans = live_spans(keys.select(*[F.col(k).alias(s) for k, s in zip(key_cols, sides)], F.col(start).alias("_start"), F.col(end).alias("_end")), sides, "_start", "_end")
    whole = (True,) * len(ref_cols)
    masks = [whole]
    if len(ref_cols) > 1 and match != "simple":  # the masks that occur, of at most 255, so no mask is a scan for nothing
        seen = refs.select(*[F.col(c).isNotNull().alias(s) for c, s in zip(ref_cols, sides)]).distinct().collect()
        masks = sorted({whole, *map(tuple, seen)}, reverse=True)
    for mask in masks:  # True: that column is given
        given = [i for i, m in enumerate(mask) if m]
        if not given:
            continue
        group = refs
        for c, m in zip(ref_cols, mask):
            group = group.where(F.col(c).isNotNull() if m else F.col(c).isNull())
        if len(given) == len(mask) or match == "partial":
            on = (F.col("_s._from") <= F.col(f"_r.{at}")) & (F.col("_s._to").isNull() | (F.col("_s._to") > F.col(f"_r.{at}")))
            for i in given:
                on &= F.col(f"_r.{ref_cols[i]}") == F.col(f"_s.{sides[i]}")
            group = group.alias("_r").join(spans.alias("_s"), on, "left_anti")
        out = group if out is None else out.unionByName(group)
    return out if out is not None else refs.limit(0)
