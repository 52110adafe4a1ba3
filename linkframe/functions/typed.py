"""Reading typed values out of text: integer, decimal, date, boolean. Surrounding white space and letter case do not
matter; what cannot be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkframe.functions.canon import EDGE_SPACE

# English month names, in order.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_WHOLE = r"[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)"
INTEGER = rf"^{_WHOLE}$"
DECIMAL = rf"^{_WHOLE}(\.[0-9]+)?$"
DATES = (r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([0-9]{2})\.([0-9]{2})\.([0-9]{4})$", r"^([0-9]{4})([0-9]{2})([0-9]{2})$", r"^([0-9]{1,2}) (" + "|".join(MONTHS) + r") ([0-9]{4})$")
BOOLEANS = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}
TYPES = ("integer", "decimal", "date", "boolean")


def trimmed(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, EDGE_SPACE, ""))


def as_number(t: Column, pattern: str, kind: str) -> Column:
    return F.when(t.rlike(pattern), F.translate(t, "+,", "")).try_cast(kind)


def as_date(t: Column) -> Column:
    """One form is made of the four, by their lengths and separators, and cast; other text fails the pattern or the cast."""
    ymd, dmy, packed, spelled = DATES
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.split_part(t, F.lit(" "), F.lit(2))).cast("string")
    iso = (
        F.when(t.rlike(ymd), t)
        .when(t.rlike(packed), F.regexp_replace(t, packed, "$1-$2-$3"))
        .when(t.rlike(dmy), F.regexp_replace(t, dmy, "$3-$2-$1"))
        .when(t.rlike(spelled), F.concat_ws("-", F.split_part(t, F.lit(" "), F.lit(3)), F.lpad(month, 2, "0"), F.lpad(F.split_part(t, F.lit(" "), F.lit(1)), 2, "0")))
    )
    return iso.try_cast("date")


def as_boolean(t: Column) -> Column:
    return F.when(t.isin([k for k, v in BOOLEANS.items() if v]), True).when(t.isin([k for k, v in BOOLEANS.items() if not v]), False)


def readable(t: Column, kind: Column) -> Column:
    """Whether trimmed text can be read as ``kind`` (any other kind: always). A readable number may still be too long for
    its column. Null for null text."""
    return (
        F.when(kind == "integer", t.rlike(INTEGER))
        .when(kind == "decimal", t.rlike(DECIMAL))
        .when(kind == "date", as_date(t).isNotNull())
        .when(kind == "boolean", t.isin(list(BOOLEANS)))
        .otherwise(True)
    )
