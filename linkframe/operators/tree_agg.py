"""Per-key results when a few keys hold most of the rows: multi-level tree aggregation.

Every input chunk (one split of the input, or one partition of a shuffle, both of bounded size) is combined where it
is read into one state per key. The states are then merged in rounds of a fixed fan-in, ``ceil(log_f(chunks))`` of
them, so no task receives more than ``fan_in`` states of a key, however many rows the key has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkframe.schema import shuffle_partitions

#: name -> (initial aggregate over rows, merge aggregate over states of that name)
States = dict[str, tuple[Column, Callable[[Column], Column]]]


def tree_aggregate(df: DataFrame, keys: Sequence[str], states: States, chunks: int | None = None, fan_in: int = 32) -> DataFrame:
    """One row per distinct ``keys`` with the merged ``states``.

    A chunk is a partition of ``df``: of a table that is read, a split of bounded size. ``chunks`` is their number or a
    bound of it; None asks the plan of ``df``, which should then hold no shuffle (it would be run for the answer). Were
    there more, the last round would only get more states. Nulls in a key form a key of their own; an empty input gives an
    empty result; columns of ``df`` that are not used are pruned, whatever their names (``_node`` excepted).
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    if chunks is None:
        chunks = df.rdd.getNumPartitions()
    out = df.withColumn("_node", F.spark_partition_id()).groupBy(*keys, "_node").agg(*[init.alias(n) for n, (init, _) in states.items()])
    merges = [merge(F.col(n)).alias(n) for n, (_, merge) in states.items()]
    nodes = -(-chunks // fan_in)
    while nodes > 1:
        out = out.withColumn("_node", (F.col("_node") / fan_in).cast("int")).groupBy(*keys, "_node").agg(*merges)
        nodes = -(-nodes // fan_in)
    return out.groupBy(*keys).agg(*merges)  # whatever the bound of the chunks was, what is left of a key is one state


_RAWIDS = 10**20  # more than any rawid
_NO_TIME = -(10**17)


def _moment(at: str, row_id: str) -> Column:
    """(time, row id) as one fixed-width number, so that the latest row needs no sort: hash aggregation can hold it."""
    micros = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(_NO_TIME)).cast("decimal(18,0)")
    return (micros * F.lit(str(_RAWIDS)).cast("decimal(21,0)") + F.coalesce(F.col(row_id), F.lit(0)).cast("decimal(20,0)")).cast("decimal(38,0)")


def _row_counts(links: DataFrame, key: str, fan_in: int) -> DataFrame:
    """(key, n_rows): counted where the splits of the input are read, so only states leave a task."""
    return tree_aggregate(links.select(F.col(key).alias("key")), ["key"], {"n_rows": (F.count(F.lit(1)), F.sum)}, None, fan_in)


def key_stats(links: DataFrame, key: str = "rel", origin: str = "origin", target: str = "target", at: str = "recorded_at", row_id: str = "rawid", fan_in: int = 32) -> DataFrame:
    """Per value of ``key``: ``n_rows``, exact ``n_origins`` and ``n_targets`` (distinct, not null), and of the row with the
    greatest time (nulls first) and, of several, the greatest row id ``latest_rawid``, ``latest_origin`` and
    ``latest_target``.

    An exact distinct count needs every value in one place once: the chunks of the input are combined to distinct (key,
    column, value) cells as they are read, the cells are spread by their hash, which a frequent key cannot unbalance, and
    the partitions of cells are the chunks of the tree. A cell knows the latest row it comes from, so the values of the
    latest row are found on the way, without a join. A null key is a key; row ids are from 0 on.
    """
    moment = _moment(at, row_id)
    cells = (
        links.select(F.col(key).alias("key"), F.posexplode(F.array(F.col(origin).cast("string"), F.col(target).cast("string"))).alias("side", "value"), moment.alias("m"))
        .groupBy("key", "side", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"))
    )
    is_origin, given = F.col("side") == 0, F.col("value").isNotNull()
    latest = lambda side: F.max(F.when(side, F.struct("m", "value")))
    states: States = {
        "n_rows": (F.sum(F.when(is_origin, F.col("n")).otherwise(0)), F.sum),
        "n_origins": (F.count_if(is_origin & given), F.sum),
        "n_targets": (F.count_if(~is_origin & given), F.sum),
        "o": (latest(is_origin), F.max),
        "t": (latest(~is_origin), F.max),
    }
    merged = tree_aggregate(cells, ["key"], states, shuffle_partitions(links.sparkSession), fan_in)
    rawid = F.expr(f"cast(pmod(o.m, cast('{_RAWIDS}' as decimal(21,0))) as bigint)")
    return merged.select(F.col("key").alias(key), "n_rows", "n_origins", "n_targets", rawid.alias("latest_rawid"), F.col("o.value").alias("latest_origin"), F.col("t.value").alias("latest_target"))


def frequent_keys(links: DataFrame, share: float, key: str = "rel", fan_in: int = 32) -> DataFrame:
    """(key, n_rows): keys that hold at least ``share`` of all rows. The total is a scalar subquery, not a join."""
    total = links.select(F.count(F.lit(1)).alias("n")).scalar()
    return _row_counts(links, key, fan_in).where(F.col("n_rows") >= F.ceil(F.lit(share).cast("decimal(18,12)") * total)).withColumnRenamed("key", key)
