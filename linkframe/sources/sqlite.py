"""Links in SQLite databases, in the two-table layout. A database of one process cannot be reached from the executors of a
cluster, and one file has one writer, so links of any number are kept in as many small databases as needed: a task fills its
own in memory, they stand as rows of Parquet files, and a match runs as SQL in each of them."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from linkframe.operators.linkset import PARTS, Linkset
from linkframe.schema import LINK_SCHEMA

#: ``n`` numbers the links of one database, since ``rawid`` may be null or repeated; ``i`` keeps the order of attributes.
_MODEL = """
CREATE TABLE relationship (n INTEGER PRIMARY KEY, rawid INTEGER, origin TEXT, rel TEXT, target TEXT, target_is_iri INTEGER);
CREATE TABLE attribute (n INTEGER, i INTEGER, name TEXT, value TEXT, PRIMARY KEY (n, i)) WITHOUT ROWID;
"""
_COLUMNS = ["link_id", *PARTS, "target_is_iri"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
_DATABASES = "n_links bigint, database binary"
#: A row is large here: pages and row groups end after a few, and a reader holds one row group at a time.
_FILES = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1", "parquet.enable.dictionary": "false"}


def write(links: Linkset, path: str, mode: str = "overwrite", database_bytes: int = 4 << 20) -> None:
    """All links with their attributes; a database is closed when it has ``database_bytes``, which no link is too large for."""
    links.df.select(*_COLUMNS, "attrs").mapInArrow(_fill(database_bytes), _DATABASES).write.mode(mode).options(**_FILES).parquet(path)


def read(spark: SparkSession, path: str, origin: str | None = None, rel: str | None = None, target: str | None = None, attrs: Mapping[str, str] | None = None) -> Linkset:
    """The links with the given parts and all of the given attributes, each with all its attributes; null and '' are wildcards."""
    given = [(p, v) for p, v in zip(PARTS, (origin, rel, target)) if v]
    tests = [f"{p} = ?" for p, _ in given] + ["EXISTS (SELECT 1 FROM attribute a WHERE a.n = r.n AND a.name = ? AND a.value = ?)"] * len(attrs or {})
    values = [v for _, v in given] + [x for pair in (attrs or {}).items() for x in pair]
    found = spark.read.schema(_DATABASES).parquet(path).select("database").mapInArrow(_select(" AND ".join(tests) or "1", values), LINK_SCHEMA)
    return Linkset(found)


def _fill(most: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, n = None, 0
        for batch in batches:
            step = max(1, batch.num_rows * (most // 4) // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                if con is None:
                    con, n = sqlite3.connect(":memory:"), 0
                    con.executescript(_MODEL)
                con.executemany("INSERT INTO relationship VALUES (?, ?, ?, ?, ?, ?)", zip(range(n, n + part.num_rows), *(part.column(c).to_pylist() for c in _COLUMNS)))
                own = part.column("attrs")
                of, pairs = pc.list_parent_indices(own).to_numpy() + n, pc.list_flatten(own)
                con.executemany("INSERT INTO attribute VALUES (?, ?, ?, ?)", zip(of.tolist(), range(len(of)), pc.struct_field(pairs, 0).to_pylist(), pc.struct_field(pairs, 1).to_pylist()))
                con.commit()
                n += part.num_rows
                if con.execute("SELECT page_count * page_size FROM pragma_page_count, pragma_page_size").fetchone()[0] >= most:
                    yield _closed(con, n)
                    con = None
        if con is not None:
            yield _closed(con, n)

    return run


def _closed(con: sqlite3.Connection, n: int) -> pa.RecordBatch:
    image = con.serialize()
    con.close()
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([image], pa.binary())], ["n_links", "database"])


def _select(where: str, values: list) -> Callable:
    links = f"SELECT n, rawid, origin, rel, target, target_is_iri FROM relationship r WHERE {where} ORDER BY n"
    own = f"SELECT n, name, value FROM attribute WHERE n IN (SELECT n FROM relationship r WHERE {where}) ORDER BY n, i" if values else "SELECT n, name, value FROM attribute ORDER BY n, i"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.column(0):
                con = sqlite3.connect(":memory:")
                con.deserialize(image.as_buffer())
                if rows := con.execute(links, values).fetchall():
                    n, *parts = zip(*rows)
                    of, names, texts = zip(*pairs) if (pairs := con.execute(own, values).fetchall()) else ((), (), ())
                    ends = np.searchsorted(np.array(of, "int64"), np.array(n, "int64"), side="right")
                    pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["name", "value"])
                    attrs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pairs)
                    columns = [pa.array(x, pa.int64()).cast(kind) if kind == pa.bool_() else pa.array(x, kind) for x, kind in zip(parts, _TYPES)]
                    yield pa.RecordBatch.from_arrays([*columns, attrs], [*_COLUMNS, "attrs"])
                con.close()

    return run
