"""The pattern query language: ``?($a, NS 'x', *) and ?(...)``, or, not, parentheses; parsed, ordered, and joined."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkframe.operators.linkset import PARTS, Linkset


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Any_:
    pass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: str


@dataclass(frozen=True)
class Match:
    args: tuple

    @property
    def variables(self) -> set[str]:
        return {a.name for a in self.args if isinstance(a, Var)}


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


_LEX = re.compile(r"""\s*(?:(?P<var>\$[A-Za-z_]\w*)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<word>[A-Za-z_]\w*)|(?P<sign>[?(),*]))""", re.S)


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _LEX.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at:].strip()[:10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    """Or binds least, then and, then not; operators of one kind group to the left."""

    def __init__(self, text: str, variables: Mapping[str, str]):
        self.toks, self.at, self.known = _tokens(text), 0, variables

    def peek(self) -> tuple[str, str]:
        return self.toks[self.at] if self.at < len(self.toks) else ("end", "")

    def take(self, *want: str) -> tuple[str, str]:
        t = self.peek()
        if want and t[1].lower() not in want and t[0] not in want:
            raise QueryError(f"expected {' or '.join(want)}, found {t[1] or 'the end'!r}")
        self.at += 1
        return t

    def word(self, w: str) -> bool:
        t = self.peek()
        return t[0] == "word" and t[1].lower() == w

    def parse(self):
        out = self.either()
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self):
        parts = [self.both()]
        while self.word("or"):
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self):
        parts = [self.unary()]
        while self.word("and"):
            self.take()
            parts.append(self.unary())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def unary(self):
        if self.word("not"):
            self.take()
            return Not(self.unary())
        if self.peek() == ("sign", "("):
            self.take()
            out = self.either()
            self.take(")")
            return out
        if self.peek()[0] == "var":
            raise QueryError("a variable stands only inside a match")
        if self.peek()[0] == "word":
            raise QueryError(f"no function {self.peek()[1]!r}")
        self.take("?")
        self.take("(")
        args = [self.arg()]
        while self.peek() == ("sign", ","):
            self.take()
            args.append(self.arg())
        self.take(")")
        if len(args) != 3:
            raise QueryError("a match has three arguments")
        return Match(tuple(args))

    def arg(self):
        kind, text = self.take("*", "var", "str", "word")
        if text == "*":
            return Any_()
        if kind == "var":
            return Var(text[1:])
        value = self.string(kind, text)
        while self.peek()[0] in ("str", "word") and not (self.word("and") or self.word("or")):
            value += self.string(*self.take())
        return Const(value)

    def string(self, kind: str, text: str) -> str:
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if text not in self.known:
            raise QueryError(f"unknown constant {text!r}")
        return self.known[text]


def parse(text: str, variables: Mapping[str, str] | None = None):
    """The syntax tree; constants are folded while parsing, so unknown names are errors here."""
    return _Parser(text, variables or {}).parse()


def _match(links: Linkset, m: Match) -> DataFrame:
    """Bindings of one pattern. A variable that stands twice must agree with itself."""
    df = links.match(*[a.value if isinstance(a, Const) else None for a in m.args]).df
    cols, seen = [], {}
    for part, a in zip(PARTS, m.args):
        if isinstance(a, Const) and a.value == "":
            continue
        if isinstance(a, Var):
            if a.name in seen:
                df = df.where(F.col(part) == F.col(seen[a.name]))
            else:
                seen[a.name] = part
                cols.append(F.col(part).alias(a.name))
    return df.select(*cols).distinct() if cols else df.select(F.lit(True).alias("_any")).limit(1)


def _ordered(parts: list, rel_counts: Mapping[str, int] | None) -> list:
    """Patterns with more constants first, then rarer rels, but always one that shares a variable with those before, so
    that no product of two unrelated sets is made while a connected order exists."""

    def cost(m) -> tuple:
        if not isinstance(m, Match):
            return (1, 0)
        const = sum(isinstance(a, Const) for a in m.args)
        rel = m.args[1].value if isinstance(m.args[1], Const) else None
        return (-const, (rel_counts or {}).get(rel, 0))

    left, out, bound = list(parts), [], set()
    while left:
        linked = [m for m in left if not bound or _variables(m) & bound] or left
        best = min(linked, key=cost)
        left.remove(best)
        out.append(best)
        bound |= _variables(best)
    return out


def _variables(node) -> set[str]:
    if isinstance(node, Match):
        return node.variables
    if isinstance(node, Not):
        return _variables(node.part)
    return set().union(*map(_variables, node.parts))


def bindings(links: Linkset, query, variables: Mapping[str, str] | None = None, rel_counts: Mapping[str, int] | None = None) -> DataFrame:
    """One row per binding of the query's variables. And is an equi-join on shared variables, or a union, not an anti-join
    against what is bound before it. Two patterns that share no variable are refused: they would be a product."""
    node = parse(query, variables) if isinstance(query, str) else query
    if isinstance(node, Match):
        return _match(links, node)
    if isinstance(node, Or):
        out = None
        for p in node.parts:
            b = bindings(links, p, variables, rel_counts)
            out = b if out is None else out.unionByName(b, allowMissingColumns=True)
        return out.distinct()
    if isinstance(node, Not):
        raise QueryError("not needs something before it: A and not B")
    out = None
    for p in _ordered([p for p in node.parts if not isinstance(p, Not)], rel_counts):
        b = bindings(links, p, variables, rel_counts)
        if out is None:
            out = b
            continue
        shared = sorted(set(out.columns) & set(b.columns))
        if not shared:
            raise QueryError("the patterns of an and must share a variable; var_sets(..., compat=True) gives the values of each by itself")
        out = out.join(b, shared)
    if out is None:
        raise QueryError("not needs something before it: A and not B")
    for p in node.parts:
        if isinstance(p, Not):
            b = bindings(links, p.part, variables, rel_counts)
            shared = sorted(set(out.columns) & set(b.columns))
            if not shared:
                raise QueryError("what is negated must share a variable")
            out = out.join(b.select(*shared), shared, "left_anti")
    return out


def var_sets(links: Linkset, query, variables: Mapping[str, str] | None = None, compat: bool = False) -> DataFrame:
    """(var, value): the values of each variable by itself. ``compat``: patterns are taken from left to right, each narrowed
    by the values of those before, but the values of earlier variables are not narrowed afterwards."""
    node = parse(query, variables) if isinstance(query, str) else query
    if not compat or not isinstance(node, And):
        rows = bindings(links, node, variables)
        return _melt(rows)
    out, known = None, {}
    for p in node.parts:
        rows = _match(links, p) if isinstance(p, Match) else bindings(links, p, variables)
        for v in sorted(set(rows.columns) & set(known)):
            rows = rows.join(known[v].select(F.col("value").alias(v)), v, "left_semi")
        for v in rows.columns:
            if v not in known:
                known[v] = rows.select(F.lit(v).alias("var"), F.col(v).alias("value")).distinct()
                out = known[v] if out is None else out.unionByName(known[v])
    return out


def _melt(rows: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("var"), F.col(c).alias("value")) for c in rows.columns])
    return rows.select(F.explode(pairs).alias("p")).select("p.var", "p.value").where("value is not null").distinct()
