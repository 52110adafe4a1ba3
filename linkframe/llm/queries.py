"""Queries of the llm operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkframe.functions.canon import canon_fields_sql, canon_sql
from linkframe.llm.duplicates import collapse, link_key
from linkframe.llm.encoding import encode_corpus
from linkframe.llm.mixing import mix
from linkframe.llm.names import link_names, same_entity_pairs
from linkframe.llm.pii import find_items, redact
from linkframe.schema import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "relationship").select("rawid", "origin", "rel", "target")
    return collapse(links, link_key(), "rawid").where("rawid <> first_id").select(F.col("first_id").alias("first_rawid"), "rawid")


def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """One link each, in the form of its first row, with the number of its copies."""
    links = table(spark, d, "relationship").select("rawid", "origin", "rel", "target")
    return collapse(links, link_key(), "rawid").where("rawid = first_id").select("rawid", "origin", "rel", "target", "n_copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    books, out = table(spark, d, "books"), None
    for field, column in (("author", "author"), ("publisher", "publisher")):
        pairs = same_entity_pairs(link_names(books, field, column)).select(F.lit(field).alias("field"), "name_a", "name_b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_items(table(spark, d, "documents"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_links, p4_found, p6_ids, p7_mix, p7_shares, p8_found, p8_redacted)}

_LIST = f"{canon_sql('rel')} LIKE '%extent' OR {canon_sql('rel')} LIKE '%imprint'"
_P2 = f"""WITH k AS (SELECT *, {canon_sql("origin")} AS o, {canon_sql("rel")} AS p,
    CASE WHEN {_LIST} THEN {canon_fields_sql("target")} ELSE {canon_sql("target")} END AS t FROM relationship),
    g AS (SELECT *, min(rawid) OVER w AS first_rawid, count(*) OVER w AS n_copies FROM k WINDOW w AS (PARTITION BY o, p, t)) """
ORACLE = {
    "p2_found": _P2 + "SELECT first_rawid, rawid FROM g WHERE rawid <> first_rawid",
    "p2_links": _P2 + "SELECT rawid, origin, rel, target, n_copies FROM g WHERE rawid = first_rawid",
}
