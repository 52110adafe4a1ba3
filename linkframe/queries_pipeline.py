"""The p-queries of the core: frequent keys, orphan references, wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkframe.functions.canon import canon, canon_sql
from linkframe.operators.orphans import orphan_references
from linkframe.operators.tree_agg import frequent_keys, key_stats
from linkframe.operators.widen import columns_of, eav_to_wide, read_terms
from linkframe.schema import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent_keys(table(spark, d, "relationship"), 0.06).select("rel")


def p1_rel_stats(spark: SparkSession, d: str) -> DataFrame:
    return key_stats(table(spark, d, "relationship"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    rel, att = table(spark, d, "relationship"), table(spark, d, "attribute")
    iri_terms = table(spark, d, "vocabulary").where("term_kind = 'rel' and value_type = 'iri'").select(canon("term").alias("_rel")).distinct()
    keys = table(spark, d, "resources").select(canon("iri").alias("iri"), "registered_at", "deleted_at")
    keys = keys.unionByName(table(spark, d, "authority").select(canon("iri").alias("iri"), "registered_at", "deleted_at"))
    # Which rels have keys as targets is a table too; it is broadcast only while Spark knows it to be small.
    kinds = rel.join(iri_terms.withColumn("_is_iri", F.lit(True)), canon("rel") == F.col("_rel"), "left")
    ends = F.array(F.struct(F.lit("relationship.origin").alias("ref_field"), F.col("origin").alias("raw")), F.struct(F.lit("relationship.target").alias("ref_field"), F.when(F.col("_is_iri"), F.col("target")).alias("raw")))
    refs = kinds.select("rawid", "recorded_at", F.explode(ends).alias("e")).where("e.raw is not null")
    refs = refs.select(F.col("e.ref_field").alias("ref_field"), F.col("rawid").alias("row_id"), F.col("recorded_at").alias("at"), canon("e.raw").alias("iri"))
    to_iris = orphan_references(refs, keys, ["iri"], ["iri"], "at", "registered_at", "deleted_at").drop("iri")
    of_links = att.select(F.lit("attribute.rawid").alias("ref_field"), F.col("attr_id").alias("row_id"), F.col("recorded_at").alias("at"), "rawid")
    to_links = orphan_references(of_links, rel.select("rawid", "recorded_at", "deleted_at"), ["rawid"], ["rawid"], "at", "recorded_at", "deleted_at").drop("rawid")
    return to_iris.unionByName(to_links).select("ref_field", F.date_format("at", "yyyy-MM").alias("period"), "row_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p3_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    field = F.split("ref_field", r"\.")
    return _orphans(spark, d).groupBy(field[0].alias("src_table"), field[1].alias("field"), "period").agg(F.count(F.lit(1)).alias("n"))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return eav_to_wide(table(spark, d, "relationship"), table(spark, d, "attribute"), read_terms(table(spark, d, "vocabulary")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).where("kind = 'unread'").select("src_table", "row_id")


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide table, numbers as doubles and lists as text. The values of a list too large for a cell would stand beside it, a
    row each as (entity, column, value); ``column`` is null in the rows of the table."""
    wide = _wide(spark, d).where("kind in ('row', 'more')").drop("kind", "ordinal", "src_table", "row_id")
    shown = lambda c, t: F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) if t.startswith("array") else F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c)
    return wide.select(*[shown(c, t) for c, t in wide.dtypes])


def p5_cells(spark: SparkSession, d: str) -> DataFrame:
    """The wide table and the values beside it as (entity, column, value), numbers apart."""
    terms = read_terms(table(spark, d, "vocabulary"))
    wide = eav_to_wide(table(spark, d, "relationship"), table(spark, d, "attribute"), terms)
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    cells = []
    for t in columns_of(terms).values():
        v = F.col(f"`{t.column}`") if t.multi else F.array(f"`{t.column}`")
        numeric = t.type in ("integer", "decimal")
        cells.append(F.transform(v, _numbers(t.column, number, text) if numeric else _texts(t.column, number)))
    rows = wide.where("kind = 'row'").select("entity", F.explode(F.flatten(F.array(*[F.coalesce(c, F.array()) for c in cells]))).alias("c")).select("entity", "c.*")
    more = wide.where("kind = 'more'").select("entity", "column", F.col("value").alias("text"), number.alias("number"))
    return rows.unionByName(more).where("text is not null or number is not null")


def _texts(name: str, none):
    return lambda x: F.struct(F.lit(name).alias("column"), x.cast("string").alias("text"), none.alias("number"))


def _numbers(name: str, none, text):
    return lambda x: F.struct(F.lit(name).alias("column"), text.alias("text"), x.cast("double").alias("number"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rel_stats, p3_found, p3_orphan_counts, p5_found, p5_wide, p5_cells)}

_LIVE = "{k}.{s} <= {r}.recorded_at AND ({k}.deleted_at IS NULL OR {k}.deleted_at > {r}.recorded_at)"
_P3 = f"""
WITH k AS (SELECT {canon_sql("iri")} AS iri, registered_at, deleted_at FROM resources
           UNION ALL SELECT {canon_sql("iri")}, registered_at, deleted_at FROM authority),
refs AS (SELECT 'relationship.origin' AS ref_field, rawid AS row_id, recorded_at, {canon_sql("origin")} AS iri FROM relationship
         UNION ALL SELECT 'relationship.target', rawid, recorded_at, {canon_sql("target")} FROM relationship
         WHERE {canon_sql("rel")} IN (SELECT {canon_sql("term")} FROM vocabulary WHERE term_kind = 'rel' AND value_type = 'iri')),
o AS (SELECT ref_field, recorded_at, row_id FROM refs WHERE iri IS NOT NULL AND NOT EXISTS
        (SELECT 1 FROM k WHERE k.iri = refs.iri AND {_LIVE.format(k="k", s="registered_at", r="refs")})
      UNION ALL SELECT 'attribute.rawid', recorded_at, attr_id FROM attribute a WHERE rawid IS NOT NULL AND NOT EXISTS
        (SELECT 1 FROM relationship r WHERE r.rawid = a.rawid AND {_LIVE.format(k="r", s="recorded_at", r="a")}))
"""
_DATE = """CASE WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(v AS DATE)
  WHEN regexp_full_match(v, '[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}') THEN try_cast(v[7:10] || '-' || v[4:5] || '-' || v[1:2] AS DATE)
  WHEN regexp_full_match(v, '[0-9]{8}') THEN try_cast(v[1:4] || '-' || v[5:6] || '-' || v[7:8] AS DATE)
  WHEN regexp_full_match(v, '[0-9]{1,2} [a-z]+ [0-9]{4}') THEN try_cast(try_strptime(v, '%d %B %Y') AS DATE) END"""
_TYPED = """
CASE t.value_type WHEN 'integer' THEN NOT regexp_full_match(v, '[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)')
 WHEN 'decimal' THEN NOT regexp_full_match(v, '[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\\.[0-9]+)?')
 WHEN 'boolean' THEN v NOT IN ('true', 'false', 'yes', 'no', '1', '0')
 ELSE CASE WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(v AS DATE)
  WHEN regexp_full_match(v, '[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}') THEN try_cast(v[7:10] || '-' || v[4:5] || '-' || v[1:2] AS DATE)
  WHEN regexp_full_match(v, '[0-9]{8}') THEN try_cast(v[1:4] || '-' || v[5:6] || '-' || v[7:8] AS DATE)
  WHEN regexp_full_match(v, '[0-9]{1,2} [a-z]+ [0-9]{4}') THEN try_cast(try_strptime(v, '%d %B %Y') AS DATE) END IS NULL END
"""
_P5 = f"""WITH n AS (SELECT {canon_sql("origin")} AS e, arg_max(origin, (-length(origin), origin)) AS entity FROM relationship GROUP BY 1),
        r AS (SELECT *, {canon_sql("origin")} AS e FROM relationship WHERE deleted_at IS NULL),
        x AS (SELECT e, 'rel' AS k, {canon_sql("rel")} AS term, target AS raw, recorded_at AS ts FROM r
              UNION ALL SELECT r.e, 'attr', {canon_sql("name")}, value, a.recorded_at FROM attribute a JOIN r ON r.rawid = a.rawid WHERE value IS NOT NULL),
        y AS (SELECT e, ts, t.col_name, t.value_type, t.is_multi, CASE WHEN t.value_type IN ('integer', 'decimal', 'date', 'boolean') THEN lower(regexp_replace(raw, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) ELSE raw END AS v
              FROM x JOIN vocabulary t ON t.term_kind = x.k AND {canon_sql("t.term")} = x.term),
        z AS (SELECT e, ts, col_name, is_multi, CASE WHEN value_type IN ('integer', 'decimal') THEN CASE WHEN regexp_full_match(v, '[+-]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)' || CASE value_type WHEN 'decimal' THEN '(\\.[0-9]+)?' ELSE '' END) THEN try_cast(replace(replace(v, ',', ''), '+', '') AS DOUBLE) END END AS number,
              CASE value_type WHEN 'integer' THEN NULL WHEN 'decimal' THEN NULL WHEN 'date' THEN strftime({_DATE}, '%Y-%m-%d') WHEN 'boolean' THEN CASE WHEN v IN ('true', 'yes', '1') THEN 'true' WHEN v IN ('false', 'no', '0') THEN 'false' END ELSE v END AS text FROM y),
        w AS (SELECT * FROM z WHERE number IS NOT NULL OR text IS NOT NULL),
        v AS (SELECT DISTINCT e, col_name, text, number FROM w WHERE is_multi
          UNION ALL SELECT e, col_name, arg_max(struct_pack(t := text), (ts, number, text)).t, arg_max(struct_pack(n := number), (ts, number, text)).n FROM w WHERE NOT is_multi GROUP BY e, col_name)
"""


def _wide_sql() -> dict[str, str]:
    """The wide table in SQL: a column for each declared term, as the vocabulary of the test tables names them."""
    try:
        import duckdb
    except ImportError:
        return {}
    try:
        terms = duckdb.sql("SELECT DISTINCT col_name, value_type, is_multi FROM '/root/testdata/sf0.001/vocabulary.parquet' ORDER BY 1").fetchall()
    except duckdb.IOException:
        return {}
    cols = []
    for name, kind, multi in terms:
        v = f"FILTER (v.col_name = '{name}')"
        if multi:
            cols.append(f"string_agg(text, '|' ORDER BY text) {v} AS \"{name}\"")
        else:
            cols.append(f"any_value({'number' if kind in ('integer', 'decimal') else 'text'}) {v}{'::' + kind.upper() if kind in ('date', 'boolean') else ''} AS \"{name}\"")
    fixed = 'NULL::VARCHAR AS "column", NULL::VARCHAR AS "value"'
    return {"p5_wide": _P5 + f"SELECT n.entity, {fixed}, {', '.join(cols)} FROM n LEFT JOIN v USING (e) GROUP BY n.e, n.entity"}


ORACLE = {
    "p1_found": "SELECT rel FROM relationship GROUP BY rel HAVING count(*) >= 0.06 * (SELECT count(*) FROM relationship)",
    "p1_rel_stats": """SELECT s.*, r.origin AS latest_origin, r.target AS latest_target FROM
        (SELECT rel, count(*) AS n_rows, count(DISTINCT origin) AS n_origins, count(DISTINCT target) AS n_targets,
                max_by(rawid, (recorded_at, rawid)) AS latest_rawid FROM relationship GROUP BY rel) s LEFT JOIN relationship r ON r.rawid = s.latest_rawid""",
    "p3_found": _P3 + "SELECT ref_field, strftime(recorded_at, '%Y-%m') AS period, row_id FROM o",
    "p3_orphan_counts": _P3 + "SELECT split_part(ref_field, '.', 1) AS src_table, split_part(ref_field, '.', 2) AS field, strftime(recorded_at, '%Y-%m') AS period, count(*) AS n FROM o GROUP BY ALL",
    "p5_found": f"""WITH x AS (SELECT 'relationship' AS src_table, rawid AS row_id, 'rel' AS k, {canon_sql("rel")} AS term, target AS value FROM relationship
        UNION ALL SELECT 'attribute', attr_id, 'attr', {canon_sql("name")}, value FROM attribute WHERE value IS NOT NULL),
        y AS (SELECT src_table, row_id, k, term, lower(regexp_replace(value, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) AS v FROM x)
        SELECT src_table, row_id FROM y JOIN vocabulary t ON t.term_kind = y.k AND {canon_sql("t.term")} = y.term
        WHERE t.value_type IN ('integer', 'decimal', 'date', 'boolean') AND {_TYPED}""",
    "p5_cells": _P5 + """SELECT n.entity, v.col_name AS "column", text, number FROM v JOIN n USING (e)""",
}
ORACLE |= _wide_sql()
