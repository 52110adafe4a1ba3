"""Entity-attribute-value rows into one wide row per entity, by positional stitching.

First every entity gets a global ordinal, in a written table. The cells are brought to the ranges of ordinals; there every
attribute is written by itself as a typed column aligned to the range, and the columns are put side by side by position.
Nothing is pivoted by key when the table is assembled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from linkframe.functions.canon import canon
from linkframe.functions.typed import DECIMAL, INTEGER, TYPES, as_boolean, as_date, as_number, readable, trimmed
from linkframe.schema import cut, shuffle_partitions, splittable

#: Type of a declared value -> (cell it is carried in, Spark type of its column).
COLUMNS = {
    "integer": ("_int", T.DecimalType(38, 0)),
    "decimal": ("_dec", T.DecimalType(38, 10)),
    "date": ("_date", T.DateType()),
    "boolean": ("_bool", T.BooleanType()),
    "string": ("_str", T.StringType()),
    "iri": ("_str", T.StringType()),
}
CELLS = {cell: kind for cell, kind in COLUMNS.values()}
#: A vocabulary is the schema of the wide table; one larger than this is refused rather than gathered.
MOST_TERMS = 20_000


@dataclass(frozen=True)
class Term:
    """A declared term: its spelling, its side ('rel' or 'attr'), column, type and whether several values are kept."""

    term: str
    kind: str
    column: str
    type: str
    multi: bool


def read_terms(vocabulary: DataFrame) -> list[Term]:
    """The declared terms, in order. Terms may share a column if they agree in type and number of values."""
    rows = vocabulary.select("term", "term_kind", "col_name", "value_type", "is_multi").where("term is not null and term_kind is not null and col_name is not null").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} declared terms")
    rows = sorted(rows, key=lambda r: (r.term_kind, r.col_name, r.term))
    return [Term(r.term, r.term_kind, r.col_name, r.value_type if r.value_type in COLUMNS else "string", bool(r.is_multi)) for r in rows]


def columns_of(terms: list[Term]) -> dict[str, Term]:
    """Column -> a term of it, in the order of the terms."""
    out: dict[str, Term] = {}
    for t in terms:
        first = out.setdefault(t.column, t)
        if (first.type, first.multi) != (t.type, t.multi):
            raise ValueError(f"{first.term!r} and {t.term!r} share the column {t.column!r} but not its type")
    return out


def _numbered(df: DataFrame, terms: list[Term], kind: str, name: str) -> DataFrame:
    """``df`` with ``_t``, the number of the column of the term that its column ``name`` names, and ``_type`` and ``_multi`` of
    it; rows of undeclared terms go. By the exact spelling where it is the declared one, else by canonical form. The
    terms are at most MOST_TERMS, so they are broadcast."""
    spark = df.sparkSession
    number = {c: i for i, c in enumerate(columns_of(terms))}
    known: dict[str, tuple[int, str, bool]] = {}
    for t in terms:
        if t.kind == kind:
            known.setdefault(canon_text(t.term), (number[t.column], t.type, t.multi))
            known[t.term] = (number[t.column], t.type, t.multi)
    side = F.broadcast(spark.createDataFrame([(k, *v) for k, v in known.items()], "_name string, _t int, _type string, _multi boolean"))
    loose = F.broadcast(spark.createDataFrame([(k, *v) for k, v in known.items()], "_name2 string, _t2 int, _type2 string, _multi2 boolean"))
    out = df.join(side, F.col(name) == F.col("_name"), "left").join(loose, F.when(F.col("_name").isNull(), canon(name)) == F.col("_name2"), "left")
    return out.withColumns({c: F.coalesce(c, c + "2") for c in ("_t", "_type", "_multi")}).drop("_name", "_name2", "_t2", "_type2", "_multi2").where("_t is not null")


def wide_schema(terms: list[Term]) -> T.StructType:
    """kind is 'row', 'unread' (a value that fits no type), 'too_long' (a number that can be read but is beyond its column) or 'more' (a
    value of a list too large for one cell). Reports have no ordinal."""
    fixed = [("kind", T.StringType()), ("ordinal", T.LongType()), ("entity", T.StringType()), ("src_table", T.StringType()), ("row_id", T.LongType()), ("column", T.StringType()), ("value", T.StringType())]
    cols = [("w_" + c if c in dict(fixed) else c, T.ArrayType(COLUMNS[t.type][1]) if t.multi else COLUMNS[t.type][1]) for c, t in columns_of(terms).items()]
    return T.StructType([T.StructField(n, k) for n, k in fixed + cols])


_FIXED = 7
#: Numbers of cells that are no values: the name of an entity, which carries its ordinal.
_NAME = -1


def written_column(field: pa.Field, term: Term, values: pa.Array, at: np.ndarray, when: np.ndarray, size: int) -> pa.Array:
    """One attribute as a column aligned to a range of ``size`` ordinals: ``values`` stand at the places ``at`` of the range. A
    single value is the one of the latest ``when``, of equal ones the greatest; a list has each value once, in order."""
    if not len(at):
        return pa.nulls(size, field.type)
    codes = values.dictionary_encode()
    place = np.empty(len(codes.dictionary), np.int64)
    place[pa.compute.sort_indices(codes.dictionary).to_numpy()] = np.arange(len(place))
    rank = place[codes.indices.to_numpy()]
    if term.multi:
        _, first = np.unique(at * len(place) + rank, return_index=True)
        counts = np.bincount(at[first], minlength=size)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.concatenate([counts == 0, [False]]))
        return pa.ListArray.from_arrays(offsets, values.take(pa.array(first)), type=field.type)
    order = np.lexsort((rank, when))  # the latest, then the greatest, is written last and stays
    take, there = np.zeros(size, np.int64), np.zeros(size, bool)
    take[at[order]] = order
    there[at] = True
    return values.take(pa.array(take, mask=~there)).cast(field.type)


def _flat(c: pa.Array | pa.ChunkedArray) -> pa.Array:
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _stitch(terms: list[Term], schema: T.StructType, span: int):
    """Arrow batches of cells, in the order of ordinals within the partition -> batches of wide rows, a range at a time."""
    fields, columns = list(to_arrow_schema(schema)), list(columns_of(terms).values())
    names = np.array([x.column for x in columns] or [""], object)

    def stitched(parts: list[tuple[pa.Table, np.ndarray]]) -> pa.RecordBatch:
        """The columns of one range, each written by itself, put side by side by position."""
        table = pa.concat_tables([t for t, _ in parts])
        ordinals = np.concatenate([o for _, o in parts])
        number, when = table.column("_t").to_numpy(), table.column("_at").to_numpy()
        cells = {c: _flat(table.column(c)) for c in CELLS}
        own = np.flatnonzero(number == _NAME)
        rows, first = ordinals[own], ordinals[own[0]]
        place = np.full(int(rows[-1] - first) + 1, -1)  # of an ordinal of the range, the position of its row
        place[rows - first] = np.arange(len(rows))
        at, size = place[ordinals - first], len(rows)
        out = [pa.array(["row"] * size), pa.array(rows), cells["_str"].take(pa.array(own)).cast(pa.string()), *[pa.nulls(size, f.type) for f in fields[3:_FIXED]]]
        by = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[by], np.arange(len(columns) + 1))
        for i, (f, t) in enumerate(zip(fields[_FIXED:], columns)):
            mine = by[bounds[i] : bounds[i + 1]]
            out.append(written_column(f, t, cells[COLUMNS[t.type][0]].take(pa.array(mine)), at[mine], when[mine], size))
        return pa.RecordBatch.from_arrays([_flat(c) for c in out], schema=pa.schema(fields))

    def passed(t: pa.Table) -> pa.RecordBatch:
        """Cells that are reports rather than values."""
        n = t.num_rows
        cols = [t.column("_kind"), pa.nulls(n, pa.int64()), t.column("_entity"), t.column("_src"), t.column("_row"), pa.array(names[t.column("_t").to_numpy()]), t.column("_str")]
        cols = [_flat(c) for c in cols] + [pa.nulls(n, f.type) for f in fields[_FIXED:]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, fields)], schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Table, np.ndarray]] = []
        last = np.int64(-1)  # the ordinal that passed last
        for batch in batches:
            t = pa.Table.from_batches([batch])
            reports = pa.compute.is_valid(t.column("_kind"))
            if (r := t.filter(reports)).num_rows:
                yield passed(r)
            t = t.filter(pa.compute.invert(reports))
            if not t.num_rows:
                continue
            # An entity's name comes before its values and carries the ordinal; the values take the last one.
            number = t.column("_t").to_numpy()
            given = np.where(number == _NAME, t.column("_row").to_numpy(zero_copy_only=False), -1).astype(np.int64)
            ordinals = np.maximum.accumulate(np.concatenate([[last], given]))[1:]
            last = ordinals[-1]
            ranges = ordinals // span
            cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1), t.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if held and ranges[a] != held[-1][1][-1] // span:
                    yield stitched(held)
                    held = []
                held.append((t.slice(a, b - a), ordinals[a:b]))
        if held:
            yield stitched(held)

    return run


def _key(c: Column) -> list[Column]:
    """An entity in 128 bits: two hashes of its canonical form."""
    return [F.xxhash64(c).alias("_e1"), F.xxhash64(F.lit(7), c).alias("_e2")]


#: A side of a join of up to so many rows (of 16 bytes) is broadcast, a larger one is not.
MOST_BROADCAST = 100_000


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def with_ordinals(entities: DataFrame, bits: int, span: int) -> DataFrame:
    """``entities`` (_e1, _e2, ...) with ``_ordinal``, unique and in the order of the keys, as a written table. A bucket is a range of
    keys (the upper ``bits`` of them); the buckets are sorted apart, and each starts at a multiple of ``span``, so that no range of
    ordinals is divided. One count a bucket is gathered, of at most 2**bits."""
    bucket = F.shiftright("_e1", 64 - bits)
    placed = entities.withColumn("_bucket", bucket).repartition("_bucket").sortWithinPartitions("_e1", "_e2").withColumn("_place", F.monotonically_increasing_id())
    placed = cut(placed)
    starts, total = [], 0
    for r in sorted(placed.groupBy("_bucket").agg(F.min("_place").alias("at"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_bucket"]):
        starts.append((r["_bucket"], total - r["at"]))
        total += -(-r.n // span) * span
    start = F.broadcast(entities.sparkSession.createDataFrame(starts, "_bucket bigint, _start bigint"))
    return placed.join(start, "_bucket").withColumn("_ordinal", F.col("_start") + F.col("_place")).drop("_bucket", "_place", "_start")


def eav_to_wide(links: DataFrame, attributes: DataFrame, terms: list[Term], cell_bytes: int = 64 << 20, hot_rows: int = 1000, span: int = 2048, buckets: int | None = None) -> DataFrame:
    """One row (kind 'row') per distinct ``links.origin`` (canonical form), with a typed column per declared term, from the
    rels of its links (``rawid, origin, rel, target, recorded_at, deleted_at``) and the attributes of those links
    (``attr_id, rawid, name, value, recorded_at``). The further kinds report what is not in a row; see ``wide_schema``.

    A column of one value has that of the latest row (of equal times the greatest value); a column of several
    has each different value once, in order. Withdrawn links (``deleted_at`` given) and their attributes give no values,
    but what cannot be read is reported for every row, also for attributes of no link; these have no entity. A null
    value is no value and not reported; a blank one is, in a typed column. Undeclared terms give nothing, a null origin
    has no row. Terms that share a column fill it together. Extra columns are ignored. Empty tables give an empty result.
    An entity has the name of its shortest spelling, of equal ones the last (so small letters before capitals).

    Every list stands in its row, whatever the entity's links are in number. Only a list of more than ``cell_bytes`` bytes of
    text, more than a row can be expected to carry, is null there and stands a value a row under kind 'more', whole. The
    values of entities with more than ``hot_rows`` links, or attributes of one link, are combined before the shuffle by
    entity; it changes no row.
    """
    spark = links.sparkSession
    schema, columns = wide_schema(terms), list(columns_of(terms).values())
    bits = max(2, (4 * (buckets or shuffle_partitions(spark)) - 1).bit_length())
    of_key = F.shiftright("_e1", 64 - bits)
    keyed = links.select("rawid", "rel", "target", "recorded_at", (F.col("deleted_at").isNull() & F.col("origin").isNotNull()).alias("_live"), "origin", *_key(canon("origin")))
    entities = keyed.where("origin is not null").groupBy("_e1", "_e2").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(-F.length("origin"), "origin")).alias("m"))
    entities = with_ordinals(entities.select("_e1", "_e2", "n", F.col("m.origin").alias("origin")), bits, span)

    micros = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(-(1 << 62)))
    rel_rows = _numbered(keyed, terms, "rel", "rel").select("_e1", "_e2", "_t", "_type", "_multi", F.col("target").alias("_raw"), F.lit("relationship").alias("_src"), F.col("rawid").alias("_row"), micros("recorded_at").alias("_at"), "_live")
    own = attributes.select("attr_id", F.col("rawid").alias("_of"), "name", F.col("value").alias("_raw"), micros("recorded_at").alias("_at")).where("_raw is not null")
    own = _numbered(own, terms, "attr", "name").drop("name")
    # A null rawid refers to no link: it takes no part in the shuffle of the join.
    of_links = own.where("_of is not null").join(keyed.where("rawid is not null").select("rawid", "_e1", "_e2", "_live"), F.col("_of") == F.col("rawid"), "left")
    order = ["_e1", "_e2", "_t", "_type", "_multi", "_raw", F.lit("attribute").alias("_src"), F.col("attr_id").alias("_row"), "_at", F.coalesce("_live", F.lit(False)).alias("_live")]
    loose = own.where("_of is null").withColumns({"_e1": F.lit(None).cast("bigint"), "_e2": F.lit(None).cast("bigint"), "_live": F.lit(False)})
    rows = rel_rows.unionByName(of_links.select(*order)).unionByName(loose.select(*order)).where("_raw is not null")

    # A value that cannot be read stays a cell of its own, with its row; others lose their rows and are combined by value.
    typed = F.col("_type").isin(*TYPES)
    rows = rows.withColumn("_value", F.when(typed, trimmed(F.col("_raw"))).otherwise(F.col("_raw")))
    long = (F.length("_value") > 24) & F.col("_type").isin("integer", "decimal")
    fits = F.when(long, F.when(F.col("_type") == "integer", as_number(F.col("_value"), INTEGER, "decimal(38,0)").isNotNull()).otherwise(as_number(F.col("_value"), DECIMAL, "decimal(38,10)").isNotNull())).otherwise(True)
    rows = rows.withColumn("_kind", F.when(typed, F.when(~readable(F.col("_value"), F.col("_type")), "unread").when(~fits, "too_long")))
    # Read once, written once: what follows takes the rows apart by plain columns.
    rows = cut(rows.select("_e1", "_e2", "_t", "_multi", "_kind", "_src", "_row", "_raw", F.when(typed, F.col("_value")).alias("_value"), "_at", "_live"))
    rows = rows.where("_kind is not null or _live")
    report = F.col("_kind").isNotNull()
    rows = rows.select("_e1", "_e2", "_t", "_multi", "_kind", F.when(report, F.col("_src")).alias("_src"), F.when(report, F.col("_row")).alias("_row"), F.when(report, F.col("_raw")).otherwise(F.coalesce("_value", "_raw")).alias("_value"), "_at")

    heavy = cut(attributes.where("rawid is not null").groupBy("rawid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("rawid"))
    hot = entities.where(F.col("n") > hot_rows).select("_e1", "_e2")
    if heavy.limit(1).count():
        hot = hot.unionByName(keyed.where("origin is not null").join(_bounded(heavy), "rawid", "left_semi").select("_e1", "_e2")).distinct()
    hot = cut(hot)
    any_hot = hot.limit(1).count() > 0
    is_hot = F.lit(False)
    if any_hot:
        rows = rows.join(_bounded(splittable(hot, "_e1").withColumn("_is", F.lit(True))), ["_e1", "_e2"], "left")
        is_hot = F.coalesce("_is", F.lit(False))
    no_report = [F.lit(None).cast(k).alias(c) for c, k in (("_kind", "string"), ("_src", "string"), ("_row", "bigint"))]
    order = ["_e1", "_e2", "_t", "_kind", "_src", "_row", "_value", "_at"]
    names = entities.select("_e1", "_e2", F.lit(_NAME).alias("_t"), no_report[0], no_report[1], F.col("_ordinal").alias("_row"), F.col("origin").alias("_value"), F.lit(0).cast("bigint").alias("_at"))
    inline, more = rows.where(report | ~is_hot).select(*order).unionByName(names), None
    if any_hot:
        # The values of a hot entity are combined before any shuffle by entity: the latest, or each different one.
        values = rows.where(~report & is_hot)
        kinds = F.array(*[F.lit(t.type) for t in columns])
        rank = F.struct("_at", *[c.alias(n) for n, c in _cells(F.get(kinds, F.col("_t")), F.col("_value")).items()], "_value")
        latest = values.where("not _multi").groupBy("_e1", "_e2", "_t").agg(F.max(rank).alias("_m"))
        latest = latest.select("_e1", "_e2", "_t", *no_report, F.col("_m._value").alias("_value"), F.col("_m._at").alias("_at"))
        different = cut(values.where("_multi").select("_e1", "_e2", "_t", "_value").distinct())
        over = cut(different.groupBy("_e1", "_e2", "_t").agg(F.sum(F.octet_length("_value")).alias("n")).where(F.col("n") > cell_bytes).select("_e1", "_e2", "_t"))
        short = different
        if over.limit(1).count():
            over = _bounded(splittable(over, "_e1"))
            short = different.join(over, ["_e1", "_e2", "_t"], "left_anti")
            more = different.join(over, ["_e1", "_e2", "_t"], "left_semi").join(entities.select("_e1", "_e2", F.col("origin").alias("_entity")), ["_e1", "_e2"], "left")
            more = more.withColumns({"_kind": F.lit("more"), "_src": F.lit(None).cast("string"), "_row": F.lit(None).cast("bigint"), "_at": F.lit(0).cast("bigint")})
        short = short.select("_e1", "_e2", "_t", *no_report, "_value", F.lit(0).cast("bigint").alias("_at"))
        inline = inline.unionByName(latest).unionByName(short)

    # To the ranges of ordinals: a bucket is a range of keys, of which the ordinals are an ascending series; an entity's name,
    # with its ordinal, sorts before its values. Reports need no order and are spread.
    bucket = F.when(report, F.pmod(F.xxhash64("_row"), F.lit(1 << bits))).otherwise(of_key)
    inline = inline.repartition(bucket).sortWithinPartitions("_e1", "_e2", "_t")
    stitch = _stitch(terms, schema, span)
    out = _typed(inline, columns, F.lit(None).cast("string")).mapInArrow(stitch, schema)
    if more is not None:
        out = out.unionByName(_typed(more, columns, F.col("_entity")).mapInArrow(stitch, schema))
    return out


def _typed(cells: DataFrame, columns: list[Term], entity: Column) -> DataFrame:
    """Each cell's value in the column of its type."""
    kinds = F.array(*[F.lit(t.type) for t in columns] or [F.lit("string")])
    kind, text = F.when(F.col("_kind").isNull() & (F.col("_t") >= 0), F.get(kinds, F.col("_t"))).otherwise("string"), F.col("_value")
    return cells.select("_e1", "_e2", "_at", "_kind", entity.alias("_entity"), "_src", "_row", "_t", *[v.alias(c) for c, v in _cells(kind, text).items()])


def _cells(kind: Column, text: Column) -> dict[str, Column]:
    """The value of a text as each of the cells; of the typed ones only that of its kind is not null."""
    return {
        "_int": F.when(kind == "integer", as_number(text, INTEGER, "decimal(38,0)")),
        "_dec": F.when(kind == "decimal", as_number(text, DECIMAL, "decimal(38,10)")),
        "_date": F.when(kind == "date", as_date(text)),
        "_bool": F.when(kind == "boolean", as_boolean(text)),
        "_str": text,
    }


def canon_text(s: str) -> str:
    """``canon`` of one string, on the driver."""
    import regex

    return regex.sub(r"[\s\p{Z}\x1c-\x1f\x85​﻿\p{P}$+<=>^`|~]+", "", s.upper()).lower()
