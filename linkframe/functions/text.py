"""Text functions as columns: slugs, pattern groups, gated replacements, splitting, guards."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column, hyphen: bool = True, lower: bool = True) -> Column:
    """Words of letters and digits, without marks, joined by '-' (or '_')."""

    def strip(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else "".join(k for k in unicodedata.normalize("NFKD", x) if not unicodedata.combining(k)).encode("ascii", "ignore").decode())

    plain = F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(F.pandas_udf(strip, "string")(c))
    out = F.regexp_replace(F.trim(F.regexp_replace(plain, r"[^\w\s-]", "")), r"[-\s_]+", "-" if hyphen else "_")
    return F.lower(out) if lower else out


def short_slug(c: Column, plain_len: int | None = None) -> Column:
    """Lower case, everything but letters and digits to single '_', cut to ``plain_len`` characters."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]", "_"), "_{2,}", "_")
    return F.substring(out, 1, plain_len) if plain_len else out


def regex_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of a match at the start; '' for a group that took no part; the input where nothing matches."""
    anchored = f"^(?:{pattern})"
    return F.when(c.rlike(anchored), F.regexp_extract(c, anchored, group)).otherwise(c)


def replace_from(c: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """Of several (pattern, replacement), the last whose pattern matches at the start is applied to the input."""
    out = c
    for pattern, new in patterns:
        out = F.when(c.rlike(f"^(?:{pattern})"), F.regexp_replace(c, pattern, new)).otherwise(out)
    return out


def split_clean(c: Column, pattern: str) -> Column:
    """Pieces without surrounding white space; blank ones go."""
    return F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != "")


def lookup(c: Column, mapping: Mapping[str, str], onmiss: str | Column | None = None) -> Column:
    """A value from a mapping, ``onmiss`` (a column, a constant or null) where the key is not there."""
    miss = onmiss if isinstance(onmiss, Column) else F.lit(onmiss).cast("string")
    if not mapping:
        return miss
    found = F.try_element_at(F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in mapping.items()])), c)
    return F.coalesce(found, miss)


def truthy(c: Column, kind: str = "string") -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False)) if kind.startswith("array") else F.coalesce(c != "", F.lit(False)) if kind == "string" else c.isNotNull()


def ifexists(test: Column, value: Column, alt: Column, kind: str = "string") -> Column:
    return F.when(truthy(test, kind), value).otherwise(alt)


def numeric_guard(c: Column) -> Column:
    """A relationship of digits only gets a '_' before it."""
    return F.when(c.rlike("^[0-9]+$"), F.concat(F.lit("_"), c)).otherwise(c)
