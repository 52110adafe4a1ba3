"""Canonical text: what stays of a value when white space, punctuation (ASCII symbols included) and letter case are
ignored. Upper case first, then lower case, so that letters with several lower-case forms meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java pattern of what is ignored: white space, separators, controls of spacing, punctuation, ASCII symbols.
IGNORED = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{200b}\x{feff}\p{P}$+<=>^`|~]+"
#: What of it is ASCII: tested by a bit a character, for texts of ASCII only.
IGNORED_ASCII = r"[\x09-\x0d\x1c-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+"
#: The same for DuckDB's RE2.
IGNORED_RE2 = r"[\s\v\p{Z}\x{1c}-\x{1f}\x{85}\x{200b}\x{feff}\p{P}$+<=>^`|~]+"
#: Between the fields of a list of named fields.
FIELD_SEP = r"[;,|&\n\r]+"

EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def canon(c: Column) -> Column:
    """Null stays null; a value of only ignored characters becomes the empty string."""
    u = F.upper(c)
    ascii_only = F.length(u) == F.octet_length(u)
    return F.lower(F.when(ascii_only, F.regexp_replace(u, IGNORED_ASCII, "")).otherwise(F.regexp_replace(u, IGNORED, "")))


def canon_fields(c: Column) -> Column:
    """Canonical form of a list of named fields, in any order: each ``name=value`` piece is made canonical as a
    whole, so a name stays with its value, and the pieces are sorted. Empty pieces count for nothing."""
    pieces = F.filter(F.transform(F.split(c, FIELD_SEP), canon), lambda p: p != "")
    return F.array_join(F.array_sort(pieces), "\x1f")


def canon_sql(c: str) -> str:
    """``canon`` for DuckDB."""
    return f"lower(regexp_replace(upper({c}), '{IGNORED_RE2}', '', 'g'))"


def canon_fields_sql(c: str) -> str:
    return (
        f"array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array({c}, '{FIELD_SEP}'), "
        f"lambda p: {canon_sql('p')}), lambda p: p <> '')), chr(31))"
    )
