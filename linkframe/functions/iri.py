"""IRI references: checking, resolving and making relative, by RFC 3986; and the same as columns."""

from __future__ import annotations

import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = re.compile(r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)
#: Characters that may not stand in a reference.
BAD = r"[\x00-\x20<>\"{}|\\^`\x7f]"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def is_reference(s: str) -> bool:
    return not re.search(BAD, s) and not re.search(r"%(?![0-9A-Fa-f]{2})", s)


def is_absolute(s: str) -> bool:
    return is_reference(s) and bool(re.match(SCHEME, s))


def _parts(s: str) -> list[str | None]:
    return list(_PARTS.match(s).groups())


def _joined(scheme, authority, path, query, fragment) -> str:
    return f"{scheme + ':' if scheme else ''}{'//' + authority if authority is not None else ''}{path}{'?' + query if query is not None else ''}{'#' + fragment if fragment is not None else ''}"


def _no_dots(path: str) -> str:
    out: list[str] = []
    pieces = path.split("/")
    for i, p in enumerate(pieces):
        last = i == len(pieces) - 1
        if p == ".":
            if last:
                out.append("")
        elif p == "..":
            if len(out) > 1 or (out and out[0] != ""):
                out.pop()
            if last:
                out.append("")
        else:
            out.append(p)
    joined = "/".join(out)
    return "/" + joined if path.startswith("/") and not joined.startswith("/") else joined


def resolve(ref: str, base: str | None) -> str:
    """The absolute form of ``ref`` seen from ``base``. Without a base the reference stays as it is."""
    if not base:
        return ref
    s, a, p, q, f = _parts(ref)
    bs, ba, bp, bq, _ = _parts(base)
    if s:
        return _joined(s, a, _no_dots(p), q, f)
    if a is not None:
        return _joined(bs, a, _no_dots(p), q, f)
    if p == "":
        return _joined(bs, ba, bp, bq if q is None else q, f)
    if p.startswith("/"):
        return _joined(bs, ba, _no_dots(p), q, f)
    merged = "/" + p if ba is not None and bp == "" else bp[: bp.rfind("/") + 1] + p
    return _joined(bs, ba, _no_dots(merged), q, f)


def relativize(iri: str, base: str) -> str:
    """A reference that ``resolve`` turns back into ``iri``; ``iri`` itself where the base is of another place."""
    s, a, p, q, f = _parts(iri)
    bs, ba, bp, *_ = _parts(base)
    if (s, a) != (bs, ba):
        return iri
    mine, theirs = p.split("/"), bp.split("/")[:-1]
    n = 0
    while n < min(len(mine) - 1, len(theirs)) and mine[n] == theirs[n]:
        n += 1
    path = "../" * (len(theirs) - n) + "/".join(mine[n:])
    if path == "" or ":" in path.split("/")[0] or path.startswith("/"):
        path = "./" + path
    return _joined(None, None, path, q, f)


def percent_encode(s: str) -> str:
    return quote(s, safe=":/?#[]@!$&'()*+,;=%-._~")


def reference(s: str) -> str:
    """``s`` itself, checked."""
    if not is_reference(s):
        raise ValueError(f"not an IRI reference: {s!r}")
    return s


def resolve_col(ref: Column, base: str | None, refs_too: bool = True) -> Column:
    """``toiri``: absolute references stay; relative ones are resolved if ``refs_too``; characters that may not stand in a
    reference are percent-encoded. Null stays null."""

    def run(s: pd.Series) -> pd.Series:
        made = {x: resolve(x if is_reference(x) else percent_encode(x), base) for x in set(s.dropna())}
        return s.map(made)

    def encode(s: pd.Series) -> pd.Series:
        return s.map({x: x if is_reference(x) else percent_encode(x) for x in set(s.dropna())})

    plain = ref.rlike(SCHEME) & ~ref.rlike(BAD + r"|/\.{1,2}(/|$)")
    return F.when(plain, ref).otherwise(F.pandas_udf(run if refs_too else encode, "string")(ref))


def abbreviate(iri: Column, base: str) -> Column:
    return F.when(iri.startswith(base), F.substring(iri, len(base) + 1, 1 << 30)).otherwise(iri)
