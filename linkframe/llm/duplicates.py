"""Records that are the same but for white space, punctuation, letter case or the order of named fields.

Two Bloom filters, of canonical hashes seen once and seen again, are built in every partition and merged page by page;
only rows whose hash may be repeated are shuffled and grouped exactly, all others are singletons as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkframe.functions.canon import canon, canon_fields
from linkframe.schema import cut, shared_dir, splittable

PAGE_BITS = 1 << 16
PAGE_BYTES = PAGE_BITS // 8
PROBES = 5


def _mixed(h: np.ndarray) -> np.ndarray:
    """A second 64-bit hash of a hash."""
    x = h.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def positions(h: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Page of each hash, and the PROBES bits within it."""
    x = _mixed(h)
    page = ((x >> np.uint64(32)) % np.uint64(pages)).astype(np.int64)
    y = _mixed(x)
    a, b = y & np.uint64(0xFFFFFFFF), (y >> np.uint64(32)) | np.uint64(1)
    bits = np.stack([((a + np.uint64(i) * b) >> np.uint64(8)) % np.uint64(PAGE_BITS) for i in range(PROBES)]).astype(np.int64)
    return page, bits


def set_bits(bitmap: np.ndarray, page: np.ndarray, bits: np.ndarray) -> None:
    at = (page * PAGE_BITS + bits).ravel()
    np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))


def has_bits(bitmap: np.ndarray, page: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = page * PAGE_BITS + bits
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def _pack(page: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(page.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


_PAGES = "page int, chunk int, once binary, again binary"


def _build(pages: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(pages * PAGE_BYTES, np.uint8), np.zeros(pages * PAGE_BYTES, np.uint8)
        for b in batches:
            h, n = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            page, bits = positions(h, pages)
            more = (n > 1) | has_bits(once, page, bits)
            set_bits(again, page[more], bits[:, more])
            set_bits(once, page, bits)
        chunk = TaskContext.get().partitionId()
        o, a = once.reshape(pages, PAGE_BYTES), again.reshape(pages, PAGE_BYTES)
        used = np.flatnonzero(o.any(axis=1))
        for part in np.array_split(used, len(used) // 512 + 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(np.full(len(part), chunk), pa.int32()), pa.array([_pack(o[i]) for i in part], pa.binary()), pa.array([_pack(a[i]) for i in part], pa.binary())], ["page", "chunk", "once", "again"]
            )

    return run


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """What two parts have both seen has been seen again."""
    once, again = np.zeros(PAGE_BYTES, np.uint8), np.zeros(PAGE_BYTES, np.uint8)
    for o, a in zip(group["once"], group["again"]):
        o = _unpack(o)
        again |= _unpack(a) | (once & o)
        once |= o
    return pd.DataFrame({"page": [group["page"].iloc[0]], "chunk": [int(group["chunk"].iloc[0])], "once": [_pack(once)], "again": [_pack(again)]})


def repeated_filter(hashes: DataFrame, pages: int, fan_in: int = 128) -> np.ndarray:
    """The merged filter of hashes seen again, of ``pages * PAGE_BYTES`` bytes. ``hashes`` has one bigint column.

    Pages are merged in rounds of ``fan_in`` partitions, as many as there must be, so no task holds more than that many
    partial pages."""
    chunks = hashes.rdd.getNumPartitions()
    parts = hashes.mapInArrow(_build(pages), _PAGES)
    while True:
        parts = parts.withColumn("chunk", F.floor(F.col("chunk") / fan_in).cast("int")).groupBy("page", "chunk").applyInPandas(_merge, _PAGES)
        chunks = -(-chunks // fan_in)
        if chunks <= 1:
            break
    bitmap = np.zeros((pages, PAGE_BYTES), np.uint8)
    for r in parts.select("page", "again").toLocalIterator(prefetchPartitions=True):  # of bounded size: the filter of one pass
        bitmap[r.page] = _unpack(bytes(r.again))
    return bitmap.ravel()


def _probe(seen, pages: int):
    def may_repeat(h: pd.Series) -> pd.Series:
        page, bits = positions(h.to_numpy(), pages)
        return pd.Series(has_bits(np.frombuffer(seen.value, np.uint8), page, bits))

    return may_repeat


def link_key(origin: str = "origin", rel: str = "rel", target: str = "target", list_rels: Sequence[str] = ("extent", "imprint")) -> Column:
    """Canonical text of a link. Null is a value of its own. Targets of ``list_rels`` (last part of the rel) are lists of
    named fields in any order."""
    r = canon(F.col(rel))
    is_list = F.lit(False)
    for name in list_rels:
        is_list |= r.endswith(name)
    parts = [canon(F.col(origin)), r, F.when(is_list, canon_fields(F.col(target))).otherwise(canon(F.col(target)))]
    return F.concat_ws("\x1e", *[F.coalesce(p, F.lit("\x00")) for p in parts])


def hash_ranges(passes: int) -> list[tuple[int, int]]:
    """Bounds, both within, of so many nearly equal parts of the 64-bit hashes."""
    edges = [-(1 << 63) + (p << 64) // passes for p in range(passes + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:])]


def collapse(rows: DataFrame, key: Column, row_id: str, bits_per_row: int = 12, filter_bytes: int = 64 << 20) -> DataFrame:
    """``rows`` with ``first_id``, the least ``row_id`` of the row's group of equal ``key``, and ``n_copies``, the rows of
    that group. Rows of ``n_copies`` 1 never left their task.

    The filter takes ``bits_per_row`` bits a row; where that is more than ``filter_bytes`` (the bound of what is sent to
    every executor), the hashes are taken in as many passes, each over its own range of them. The rows are written once with
    their hash, sorted by it within each file if there are several passes, so a pass reads its own part of every file; a
    pass writes its rows with what the filter says, and its filter is destroyed before the next, so one is alive at a time.
    The plan of the result does not depend on the passes. A false positive costs a shuffled row, never a wrong group. A
    group of any size is combined before the shuffle and joined back with adaptive skew handling.

    Columns of ``rows`` called ``first_id`` or ``n_copies`` are replaced, all others kept. Null ids are allowed but never the
    first unless all of a group are null; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    own = "_c"
    while any(c.startswith(own) for c in rows.columns):
        own += "_"
    k, h, maybe_ = own + "key", own + "hash", own + "maybe"  # no column of the rows is called so
    n = rows.count()
    total = max(1, -(-n * bits_per_row // PAGE_BITS))
    passes = max(1, -(-total * PAGE_BYTES // filter_bytes))
    pages = -(-total // passes)
    hashed = rows.drop("first_id", "n_copies").withColumn(h, F.xxhash64(key))
    hashed = cut(hashed.sortWithinPartitions(h) if passes > 1 else hashed)
    path = shared_dir(spark)
    for p, (least, most) in enumerate(hash_ranges(passes)):
        part = hashed.where(F.col(h).between(least, most)) if passes > 1 else hashed
        seen = spark.sparkContext.broadcast(repeated_filter(part.select(h), pages).tobytes())
        probed = part.withColumn(maybe_, F.pandas_udf(_probe(seen, pages), "boolean")(h)).drop(h)
        probed = probed.withColumn(k, F.when(F.col(maybe_), key))
        probed.write.mode("append").parquet(path)
        schema = probed.schema
        seen.destroy()
    probed = spark.read.schema(schema).parquet(path)
    single = probed.where(~F.col(maybe_)).drop(maybe_, k).withColumns({"first_id": F.col(row_id), "n_copies": F.lit(1).cast("bigint")})
    maybe = probed.where(F.col(maybe_)).drop(maybe_)
    groups = maybe.groupBy(k).agg(F.min(row_id).alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return single.unionByName(maybe.join(splittable(groups, k), k).drop(k))
