"""Graph-to-graph transforms by rules: fingerprint, transform, label; compiled to joins.

An action is an immutable tree. It is compiled against a *context relation*, one row per context (a link being worked, with
the variables in reach), into an array column of values; actions that make links add rows to the output on the way. A
stage is a union over its rules, so all input resources are worked at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkframe.functions.hashing import entity_id, hash_id
from linkframe.functions.iri import resolve, resolve_col
from linkframe.functions.text import replace_from as replace_column
from linkframe.operators.graph import follow as follow_path
from linkframe.operators.linkset import NO_ATTRS, Linkset
from linkframe.schema import FINGERPRINT, LABEL, TYPE, cut

_EMPTY = "cast(array() as array<string>)"
_names = count()
_OUT = ["origin", "rel", "target", "target_is_iri", "attrs"]


def _new(prefix: str) -> str:
    return f"_{prefix}{next(_names)}"


def _one(c: Column) -> Column:
    """A list of one value, or none where it is null."""
    return F.when(c.isNotNull(), F.array(c)).otherwise(F.expr(_EMPTY))


def _named(values: Column, name: str) -> Column:
    return F.transform(values, lambda e: F.struct(F.lit(name).alias("name"), e.alias("value")))


@dataclass
class Env:
    """What an action sees besides the columns of its contexts: the model it reads, variables (name -> column), extras,
    and where links and entities that it makes go."""

    model: Linkset
    vars: dict[str, str] = field(default_factory=dict)
    single: frozenset[str] = frozenset({"input-resource", "@stem"})
    extras: Mapping = field(default_factory=dict)
    base: str | None = None
    links: list[DataFrame] = field(default_factory=list)
    made: list[DataFrame] = field(default_factory=list)
    resources: DataFrame | None = None  # (in_rid, mains)
    id_helper: Callable[[Column, Column, Column], Column] | None = None

    def emit(self, df: DataFrame, origin: Column, rel: Column, target: Column, is_iri: Column, attrs: Column | None = None, creates: Column | None = None) -> None:
        """Links made; ``creates``: the entity that is created with them, None for links that are not part of a creation."""
        attrs = attrs if attrs is not None else F.expr(NO_ATTRS)
        by = creates if creates is not None else F.lit(None).cast("string")
        row = df.select(origin.alias("origin"), rel.alias("rel"), target.alias("target"), is_iri.cast("boolean").alias("target_is_iri"), attrs.alias("attrs"), by.alias("_by"))
        self.links.append(row.where("origin is not null and rel is not null and target is not null and origin <> ''"))

    def absolute(self, rel: Column) -> Column:
        guarded = F.when(rel.rlike("^[0-9]+$"), F.concat(F.lit("_"), rel)).otherwise(rel)
        return resolve_col(guarded, self.base) if self.base else guarded


class Action:
    """``lower`` gives the contexts, perhaps with more columns, and the values as an array of strings. ``emits``: whether
    links are made, so that the contexts must be split rather than the values chosen where it stands under a condition."""

    emits = False

    def lower(self, df: DataFrame, env: Env) -> tuple[DataFrame, Column]:
        raise NotImplementedError


def _action(x) -> Action:
    return x if isinstance(x, Action) else Const(x)


def _emits(*xs) -> bool:
    return any(isinstance(x, Action) and x.emits for x in xs)


@dataclass(frozen=True)
class Const(Action):
    value: object

    def lower(self, df, env):
        v = self.value
        if isinstance(v, (list, tuple, set)) and any(isinstance(x, Action) for x in v):
            return Values(*v).lower(df, env)
        items = [] if v is None else [str(x) for x in (sorted(v) if isinstance(v, set) else v) if x is not None] if isinstance(v, (list, tuple, set)) else [str(v)]
        return df, F.array(*[F.lit(x) for x in items]) if items else F.expr(_EMPTY)


@dataclass(frozen=True)
class Var(Action):
    name: str

    def lower(self, df, env):
        return df, F.col(env.vars[self.name]) if self.name in env.vars else F.expr(_EMPTY)


@dataclass(frozen=True)
class Extra(Action):
    name: str
    default: object = None

    def lower(self, df, env):
        return Const(env.extras.get(self.name, self.default)).lower(df, env)


@dataclass(frozen=True)
class Part(Action):
    column: str

    def lower(self, df, env):
        return df, _one(F.col(self.column))


@dataclass(frozen=True)
class Attr(Action):
    name: str

    def lower(self, df, env):
        return df, F.transform(F.filter("_a", lambda e: e.getField("name") == self.name), lambda e: e.getField("value"))


class Values(Action):
    """All values of several actions, in order."""

    def __init__(self, *items):
        self.items, self.emits = items, _emits(*items)

    def lower(self, df, env):
        cols = []
        for x in self.items:
            df, c = _action(x).lower(df, env)
            cols.append(c)
        return df, F.concat(*cols) if cols else F.expr(_EMPTY)


class Choose(Action):
    """``yes`` where the test has a value that is not empty (or a condition on columns holds), else ``no``."""

    def __init__(self, test, yes, no=None):
        self.test, self.yes, self.no, self.emits = test, yes, no, _emits(test, yes, no)

    def lower(self, df, env):
        if isinstance(self.test, Column):
            cond = self.test
        elif isinstance(self.test, str):
            names = {f"var_{re.sub(r'\W', '_', k)}": F.col(v) for k, v in env.vars.items()} | {"origin": F.col("_o"), "rel": F.col("_r"), "target": F.col("_t")}
            made = {n: _new("x") for n in names}
            df = df.withColumns({made[n]: c for n, c in names.items()})
            cond = F.expr(re.sub(r"\b(" + "|".join(map(re.escape, names)) + r")\b", lambda m: made[m[1]], self.test))
        else:
            df, t = _action(self.test).lower(df, env)
            cond = F.exists(t, lambda x: x != "")
        flag = _new("if")
        df = df.withColumn(flag, F.coalesce(cond, F.lit(False)))
        if not _emits(self.yes, self.no):
            df, y = _action(self.yes).lower(df, env)
            df, n = _action(self.no).lower(df, env)
            return df, F.when(F.col(flag), y).otherwise(n)
        out, result = None, _new("v")
        for side, action in ((True, self.yes), (False, self.no)):
            part, c = _action(action).lower(df.where(F.col(flag) == side), env)
            part = part.withColumn(result, c).select(*df.columns, result)
            out = part if out is None else out.unionByName(part)
        return out, F.col(result)


class Contains(Action):
    """A value ('true') where any of ``values`` is among those of ``items``."""

    def __init__(self, items, values):
        self.items, self.values = items, values

    def lower(self, df, env):
        df, a = _action(self.items).lower(df, env)
        df, b = _action(self.values if self.values is not None else target()).lower(df, env)
        return df, F.when(F.arrays_overlap(a, b), F.array(F.lit("true"))).otherwise(F.expr(_EMPTY))


def _context_key(df: DataFrame) -> Column:
    """What a context is, all of its columns with the nulls in their places, as a digest of 256 bits."""
    return F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)


def _fan(df: DataFrame, values: Column, name: str) -> DataFrame:
    """A row per value, with ``_key`` to gather them again."""
    return df.withColumn("_key", _context_key(df)).withColumn(name, F.explode(values))


def _gather(df: DataFrame, parts: DataFrame, values: Column, order: Column | None = None) -> tuple[DataFrame, Column]:
    """The values of the parts of each context as one list."""
    out, key = _new("v"), _new("k")
    item = F.struct(order if order is not None else F.lit(0), values.alias("v"))
    lists = parts.groupBy(F.col("_key").alias(key)).agg(F.flatten(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.v)).alias(out))
    keyed = df.withColumn("_key2", _context_key(df)).dropDuplicates(["_key2"])
    return keyed.join(lists, F.col("_key2") == F.col(key), "left").drop("_key2", key), F.coalesce(F.col(out), F.expr(_EMPTY))


class Follow(Action):
    """Ends of the path along ``rels`` in the model, from the origin of the context or from the values of ``origin``."""

    def __init__(self, *rels, origin=None, action=None):
        self.rels, self.origin, self.action, self.emits = rels, origin, action, _emits(action)

    def lower(self, df, env):
        rels = [r.value if isinstance(r, Const) else r for r in self.rels]
        if len(rels) == 1:
            ends = env.model.match(None, rels[0]).df.where("target is not null").groupBy(F.col("origin").alias("_fo")).agg(F.transform(F.array_sort(F.collect_list(F.struct("link_id", "target"))), lambda x: x.target).alias("_ft"))
        else:
            ends = follow_path(env.model, rels).where("target is not null").groupBy(F.col("origin").alias("_fo")).agg(F.array_sort(F.collect_list("target")).alias("_ft"))
        out = _new("f")
        if self.origin is None or (isinstance(self.origin, Var) and self.origin.name in env.single) or (isinstance(self.origin, Part)):
            start = F.col("_o") if self.origin is None else F.get(_action(self.origin).lower(df, env)[1], F.lit(0))
            key = _new("s")
            df = df.withColumn(key, start).join(ends.withColumnRenamed("_ft", out), F.col(key) == F.col("_fo"), "left").drop("_fo", key)
            values = F.coalesce(F.col(out), F.expr(_EMPTY))
        else:
            df, starts = _action(self.origin).lower(df, env)
            parts = _fan(df, starts, "_s").join(ends, F.col("_s") == F.col("_fo"))
            df, values = _gather(df, parts, F.col("_ft"), F.col("_s"))
        if self.action is None:
            return df, values
        parts = _fan(df, values, "_t2").withColumn("_t", F.col("_t2"))
        parts, c = _action(self.action).lower(parts, env)
        return _gather(df, parts, c, F.col("_t2"))


class Lookup(Action):
    """A value from a mapping (given, or named among the extras; '@resource' are the output resources of an input one)."""

    def __init__(self, mapping, key=None, onmiss=None):
        self.mapping, self.key, self.onmiss = mapping, key, onmiss

    def lower(self, df, env):
        df, k = _action(self.key if self.key is not None else target()).lower(df, env)
        miss = _action(self.onmiss).lower(df, env)[1]
        k = F.get(k, F.lit(0))
        if self.mapping == "@resource":
            if env.resources is None:
                return df, miss
            name, key = _new("m"), _new("k")
            table = env.resources.select(F.col("in_rid").alias(key + "r"), F.col("mains").alias(name))
            df = df.withColumn(key, k).join(table, F.col(key) == F.col(key + "r"), "left").drop(key, key + "r")
            return df, F.coalesce(F.col(name), miss)
        mapping = self.mapping if isinstance(self.mapping, Mapping) else (env.extras.get("lookups") or env.extras)[self.mapping]
        if not mapping:
            return df, miss
        entries = F.map_from_entries(F.array(*[F.struct(F.lit(a), F.lit(str(b))) for a, b in mapping.items()]))
        found = F.try_element_at(entries, k)
        return df, F.when(found.isNotNull(), F.array(found)).otherwise(miss)


class Mapped(Action):
    """A function of one column over every value."""

    def __init__(self, fn: Callable[[Column], Column], arg=None, distinct: bool = False):
        self.fn, self.arg, self.distinct = fn, arg, distinct

    def lower(self, df, env):
        df, v = _action(self.arg if self.arg is not None else target()).lower(df, env)
        out = F.filter(F.transform(v, lambda x: self.fn(x)), lambda x: x.isNotNull())
        return df, F.array_distinct(out) if self.distinct else out


class ToIri(Action):
    def __init__(self, arg=None, base: str | None = None, refs_too: bool = False):
        self.arg, self.base, self.refs_too = arg, base, refs_too

    def lower(self, df, env):
        df, v = _action(self.arg if self.arg is not None else target()).lower(df, env)
        name, base = _new("v"), self.base or env.base
        df = df.withColumn(name, v)
        # Python functions cannot stand inside a transform: values are encoded one by one outside of it.
        parts = _fan(df, F.col(name), "_x")
        df, out = _gather(df, parts, F.array(resolve_col(F.col("_x"), base, self.refs_too)), F.col("_x"))
        return df, out


class Compose(Action):
    """compose(f, g): g of the context, then f of each of its values as the target."""

    def __init__(self, *actions):
        self.actions, self.emits = actions, _emits(*actions)

    def lower(self, df, env):
        df, v = _action(self.actions[-1]).lower(df, env)
        for a in reversed(self.actions[:-1]):
            parts = _fan(df, v, "_t2").withColumn("_t", F.col("_t2"))
            parts, c = _action(a).lower(parts, env)
            df, v = _gather(df, parts, c, F.col("_t2"))
        return df, v


class Ignore(Action):
    def lower(self, df, env):
        return df, F.expr(_EMPTY)


def _exploded(df: DataFrame, env: Env, parts: Mapping[str, object]) -> DataFrame:
    """The contexts times the values of some of their parts; None leaves a part as it is."""
    made = {}
    for col, x in parts.items():
        if x is not None:
            df, v = _action(x).lower(df, env)
            made[col] = _new("x")
            df = df.withColumn(made[col], v)
    for col, name in made.items():
        df = df.withColumn("_x", F.explode(name)).withColumn(col, F.col("_x")).drop("_x")
    return df


class ForEach(Action):
    """``action`` for every combination of the given origins, rels and targets; ``attributes`` (name -> values) are those of the
    contexts made."""

    emits = True

    def __init__(self, origin=None, rel=None, target=None, attributes: Mapping[str, object] | None = None, action=None):
        self.origin, self.rel, self.target, self.attributes, self.action = origin, rel, target, attributes, action

    def contexts(self, df: DataFrame, env: Env) -> DataFrame:
        if self.attributes is not None:
            df, pairs = _attributes(df, env, self.attributes)
            df = df.withColumn("_a", pairs)
        return _exploded(df, env, {"_o": self.origin, "_r": self.rel, "_t": self.target}).where("_o is not null and _o <> ''")

    def lower(self, df, env):
        if self.action is None:
            raise ValueError("foreach without an action stands only as the rel of a materialized link")
        _action(self.action).lower(self.contexts(df, env), env)
        return df, F.expr(_EMPTY)


def _attributes(df: DataFrame, env: Env, given: Mapping[str, object]) -> tuple[DataFrame, Column]:
    """Attributes of computed values, as a sorted array."""
    pairs = []
    for k, x in given.items():
        df, v = _action(x).lower(df, env)
        pairs.append(_named(v, k))
    return df, F.array_sort(F.concat(*pairs)) if pairs else F.expr(NO_ATTRS)


class UserFunction(Action):
    """A Python function of one value, a text or None, in Arrow batches: for what no column expression can say. It gives a text,
    None, or a list of texts."""

    def __init__(self, fn: Callable[[str], str | list[str] | None], arg=None):
        self.fn, self.arg = fn, arg

    def lower(self, df, env):
        df, v = _action(self.arg if self.arg is not None else target()).lower(df, env)
        name, fn = _new("v"), self.fn

        def run(s: pd.Series) -> pd.Series:
            made = ([] if x is None else x if isinstance(x, list) else [x] for x in map(fn, s))
            return pd.Series([[y for y in x if y is not None] for x in made], dtype=object)

        df = df.withColumn(name, v)
        # A Python function cannot stand inside a transform: values are taken one by one outside of it.
        parts = _fan(df, F.col(name), "_x")
        return _gather(df, parts, F.pandas_udf(run, "array<string>")(F.col("_x")), F.col("_x"))


class Relation(Action):
    """A function over batches of contexts (origin, rel, target) that gives batches of links (origin, rel, target,
    target_is_iri): for rules that no other action can say."""

    emits = True

    def __init__(self, fn: Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]]):
        self.fn = fn

    def lower(self, df, env):
        here = df.select(F.col("_o").alias("origin"), F.col("_r").alias("rel"), F.col("_t").alias("target"))
        made = here.mapInPandas(self.fn, "origin string, rel string, target string, target_is_iri boolean")
        env.emit(made, F.col("origin"), env.absolute(F.col("rel")), F.col("target"), F.col("target_is_iri"))
        return df, F.expr(_EMPTY)


class MakeLink(Action):
    """A link for every combination of origins, rels and targets; parts not given are those of the context."""

    emits = True

    def __init__(self, origin=None, rel=None, target=None, value=None, attributes: Mapping[str, object] | None = None, source=None):
        self.origin, self.rel, self.target, self.attributes, self.source = origin, rel, target if target is not None else value, attributes or {}, source

    def lower(self, df, env):
        here = self.source.contexts(df, env) if isinstance(self.source, ForEach) else df
        here, pairs = _attributes(here, env, self.attributes)
        name = _new("a")
        here = here.withColumn(name, pairs)
        plain = self.target is None
        here = _exploded(here, env, {"_o": self.origin, "_r": self.rel, "_t": self.target})
        is_iri = F.col("_ti") if plain else F.lit(bool(isinstance(self.target, (Materialize, Lookup, ToIri, Part)) and getattr(self.target, "column", "_o") == "_o"))
        env.emit(here, F.col("_o"), env.absolute(F.col("_r")), F.col("_t"), is_iri, F.col(name))
        return df, F.expr(_EMPTY)


@dataclass(frozen=True)
class Copy:
    """In place of a type: the resource itself, with those of its links whose rel is among ``rels`` (None: all)."""

    rels: frozenset | None = None


class Materialize(Action):
    """An entity of a type, whose id is a hash of its fingerprint; attached to the origin, typed, and with links of its own."""

    emits = True

    def __init__(self, typ, rel=None, origin=None, fprint=None, unique=None, links=(), split: str | None = None, attach: bool = True, preserve_fprint: bool = False, vars: Mapping[str, object] | None = None):
        if typ is None:
            raise ValueError("an entity needs a type")
        self.typ, self.rel, self.origin, self.links, self.split = typ, rel, origin, tuple(links), split
        self.fprint, self.attach, self.preserve, self.vars = tuple(fprint or unique or ()), attach, preserve_fprint, dict(vars or {})

    def lower(self, df, env):
        whole, outer = df, dict(env.vars)
        mine = {}
        for name, x in self.vars.items():
            df, v = _action(x).lower(df, env)
            col = _new("var")
            before = F.col(outer[name]) if name in outer else F.expr(_EMPTY)
            df = df.withColumn(col, F.when(F.size(v) > 0, v).otherwise(before))
            mine[name] = col
        env = replace(env, vars=outer | mine)  # links and made stay the same lists
        if self.split is not None:
            parts = _fan(df, F.filter(F.transform(F.split("_t", self.split), lambda x: F.trim(x)), lambda x: x != ""), "_t2").withColumn("_t", F.col("_t2"))
        else:
            parts = df
        parts, rid = self._entity(parts, env)
        if self.split is not None:
            return _gather(df, parts, F.array(rid), F.col("_t2"))
        return (parts, _one(rid)) if whole is not None else (parts, rid)

    def _entity(self, df: DataFrame, env: Env) -> tuple[DataFrame, Column]:
        rid, o = _new("rid"), _new("o")
        if isinstance(self.typ, Copy):
            df = df.withColumn(rid, F.col("_o"))
            src = env.model.match(None, self.typ.rels or None).df.select(F.col("origin").alias("_co"), F.col("rel").alias("_cr"), F.col("target").alias("_ct"), F.col("target_is_iri").alias("_ci"))
            env.emit(df.join(src, F.col(rid) == F.col("_co")), F.col("_co"), F.col("_cr"), F.col("_ct"), F.col("_ci"))
            types = None
        else:
            df, types = _action(self.typ).lower(df, env)
            keys, vals = [], []
            for k, v in self.fprint:
                if k is None or v is None:
                    continue
                df, kc = _action(k).lower(df, env)
                df, vc = _action(v).lower(df, env)
                vc = F.filter(vc, lambda x: x.isNotNull() & (x != ""))
                keys.append(F.array_repeat(F.get(kc, F.lit(0)), F.size(vc)))
                vals.append(vc)
            k, v, ty = _new("k"), _new("v"), _new("ty")
            given_k, given_v = F.concat(*keys) if keys else F.expr(_EMPTY), F.concat(*vals) if vals else F.expr(_EMPTY)
            df = df.withColumns({k: given_k, v: given_v, ty: types})
            first = F.get(F.col(ty), F.lit(0))
            more = F.transform(F.filter(F.arrays_zip(F.col(k).alias("k"), F.col(v).alias("v")), lambda p: p.k == TYPE), lambda p: p.v)
            df = df.withColumn(ty, F.array_distinct(F.concat(F.col(ty), more)))
            extra = F.array_except(F.col(ty), F.array(first))
            # An entity of which nothing but its type is known gets an id of its own context, the same on every run.
            own = F.size(F.filter(k, lambda x: x != TYPE)) == 0
            anon = F.concat_ws("\x1f", F.lit("anon"), "_in", "_o", "_r", "_t", first)
            df = df.withColumn(rid, F.when(own, hash_id(F.when(own, anon))).otherwise((env.id_helper or entity_id)(first, F.concat(F.col(k), F.array_repeat(F.lit(TYPE), F.size(extra))), F.concat(F.col(v), extra))))
            if env.base:
                df = df.withColumn(rid, F.when(first.isNotNull(), resolve_col(F.col(rid), env.base)))
        if self.origin is not None:
            df, oc = _action(self.origin).lower(df, env)
            df = df.withColumn(o, F.get(oc, F.lit(0)))
        else:
            df = df.withColumn(o, F.col("_o"))
        env.made.append(df.where(f"{rid} is not null").select(F.col("_in").alias("in_rid"), F.col(rid).alias("out_rid")))
        if self.attach:
            at, rels = (df, _one(F.col("_r"))) if self.rel is None else _action(self.rel).lower(df, env)
            env.emit(at.withColumn("_x", F.explode(F.filter(rels, lambda x: x != ""))), F.col(o), env.absolute(F.col("_x")), F.col(rid), F.lit(True))
        if types is not None:
            full = resolve_col(F.get(F.col(ty), F.lit(0)), env.base) if env.base else F.get(F.col(ty), F.lit(0))
            env.emit(df, F.col(rid), F.lit(TYPE), full, F.lit(True), None, F.col(rid))
            if self.preserve:
                pairs = F.filter(F.arrays_zip(F.col(k).alias("name"), F.col(v).alias("value")), lambda p: p["name"] != TYPE)
                pairs = F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")))
                kept = F.array_sort(F.array_distinct(F.concat(pairs, F.transform(F.col(ty), lambda t: F.struct(F.lit(TYPE).alias("name"), t.alias("value"))))))
                env.emit(df, F.col(rid), F.lit(FINGERPRINT), F.get(F.col(ty), F.lit(0)), F.lit(True), kept, F.col(rid))
        stem = _new("stem")
        inner = df.withColumn(stem, _one(F.col("_o"))).withColumn("_o", F.col(rid))
        vein = replace(env, vars=env.vars | {"@stem": stem})
        for link in self.links:
            lo, lr, lt = link if len(link) == 3 else (None, *link)
            here = inner
            if isinstance(lr, ForEach):
                _action(lt).lower(lr.contexts(here, vein), vein)
                continue
            if lr is not None:
                here, rc = _action(lr).lower(here, vein)
                here = here.withColumn("_r", F.get(rc, F.lit(0)))
            here = here.where("_r is not null and _r <> ''")
            here, tc = _action(lt if lt is not None else target()).lower(here, vein)
            name = _new("t")
            here = here.withColumn(name, F.explode(F.filter(tc, lambda x: x != "")))
            origins = F.col("_o")
            if lo is not None:
                here, oc = _action(lo).lower(here, vein)
                here = here.withColumn("_lo", F.explode(oc))
                origins = F.col("_lo")
            is_iri = isinstance(lt, (Materialize, Lookup, ToIri)) or (isinstance(lt, Var) and lt.name == "@stem") or (isinstance(lt, Part) and lt.column == "_o") or lr == TYPE
            vein.emit(here, origins, vein.absolute(F.col("_r")), F.col(name), F.lit(bool(is_iri)), None, F.col(rid))
        return df, F.col(rid)


# --- the vocabulary of rules


def const(value):
    return Const(value)


def var(name):
    return Var(name)


def extra(name, default=None):
    return Extra(name, default)


def attr(name):
    return Attr(name)


def rel():
    return Part("_r")


def target():
    return Part("_t")


class ComputedOrigin(Action):
    """The id of the entity of a fingerprint, whose first key must be the type."""

    def __init__(self, fprint):
        if not fprint or fprint[0][0] != TYPE:
            raise ValueError("the first key of a fingerprint must be the type")
        self.fprint = fprint

    def lower(self, df, env):
        df, types = _action(self.fprint[0][1]).lower(df, env)
        keys, vals = [], []
        for k, v in self.fprint[1:]:
            df, vc = _action(v).lower(df, env)
            keys.append(F.array_repeat(F.lit(k), F.size(vc)))
            vals.append(vc)
        empty = F.expr(_EMPTY)
        name = _new("rid")
        df = df.withColumn(name, entity_id(F.get(types, F.lit(0)), F.concat(*keys) if keys else empty, F.concat(*vals) if vals else empty, env.base))
        return df, F.array(F.col(name))


def origin(fprint=None):
    return Part("_o") if fprint is None else ComputedOrigin(fprint)


def values(*items):
    return Values(*items)


def ifexists(test, value, alt=None):
    return Choose(test, value, alt)


if_ = ifexists


def contains(items, value=None):
    return Contains(items, value)


def follow(*rels, origin=None, action=None):
    return Follow(*rels, origin=origin, action=action)


def lookup(mapping, key=None, onmiss=None):
    return Lookup(mapping, key, onmiss)


def regex_match_modify(pattern: str, group: int | Callable[[Callable[[int], Column]], Column] = 1, arg=None):
    """A group of the match at the start, or a column made of its groups (``lambda g: F.concat(g(2), g(1))``); values that do not
    match stay as they are."""
    anchored = f"^(?:{pattern})"
    made = group if callable(group) else lambda g: g(group)
    return Mapped(lambda c: F.when(c.rlike(anchored), made(lambda i: F.regexp_extract(c, anchored, i))).otherwise(c), arg)


def replace_from(patterns: Sequence[tuple[str, str]], arg=None):
    return Mapped(lambda c: replace_column(c, patterns), arg, True)


def column_action(fn: Callable[[Column], Column], arg=None):
    """Any function of a column as an action."""
    return Mapped(fn, arg)


def udf_action(fn: Callable[[str], str | list[str] | None], arg=None):
    """A Python function of each value as an action."""
    return UserFunction(fn, arg)


def relation_action(fn):
    """A function over batches of contexts that gives links, as an action."""
    return Relation(fn)


def compose(*actions):
    return Compose(*actions)


def ignore():
    return Ignore()


def toiri(arg=None, base=None, ignore_refs=True):
    return ToIri(arg, base, not ignore_refs)


def foreach(origin=None, rel=None, target=None, attributes=None, action=None):
    return ForEach(origin, rel, target, attributes, action)


def link(origin=None, rel=None, target=None, value=None, attributes=None, source=None):
    return MakeLink(origin, rel, target, value, attributes, source)


def materialize(typ, rel=None, **options):
    return Materialize(typ, rel, **options)


def COPY(rels: Iterable[str] | None = None):
    return Copy(None if rels is None else frozenset(rels))


class Template(Action):
    emits = True

    def __init__(self, proto: Action, terms: Mapping[str, object]):
        self.proto, self.terms = proto, terms

    def lower(self, df, env):
        bound = {}
        for name, x in self.terms.items():
            df, v = _action(x).lower(df, env)
            bound[name] = _new("var")
            df = df.withColumn(bound[name], v)
        return self.proto.lower(df, replace(env, vars=env.vars | bound))


def action_template(proto: Action):
    """An action with terms to be bound: ``action_template(p)(title=..., lang=...)``."""
    return lambda **terms: Template(proto, terms)


# --- the pipeline


@dataclass
class Result:
    """``output`` links; ``fingerprints`` (in_rid, out_rid, is_main); ``misses``: links of fingerprinted resources that no
    rule took; ``blank_labels`` (origin, type); ``complete``: False where the pipeline ended without any entity;
    ``firings`` (rule, n): how often each transform rule was run; ``entities`` (out_rid): all that were met."""

    output: Linkset
    fingerprints: DataFrame
    misses: DataFrame
    blank_labels: DataFrame
    complete: bool
    firings: DataFrame | None = None
    entities: DataFrame | None = None


def run_actions(contexts: Iterable[tuple[DataFrame, Action]], model: Linkset, base: str | None = None, extras: Mapping | None = None) -> Linkset:
    """Links that actions make of contexts (in_rid, origin, rel, target, target_is_iri, attrs), without stages."""
    env = Env(model, base=base, extras=extras or {})
    for df, action in contexts:
        _action(action).lower(_contexts(df), env)
    return _collected(env, model)


def _contexts(df: DataFrame) -> DataFrame:
    return df.select(F.col("in_rid").alias("_in"), F.col("origin").alias("_o"), F.col("rel").alias("_r"), F.col("target").alias("_t"), F.col("target_is_iri").alias("_ti"), F.col("attrs").alias("_a"))


def _rows(env: Env, model: Linkset) -> DataFrame:
    """All links made in a stage, with the entity that each is part of the creation of."""
    out = None
    for df in env.links:
        out = df if out is None else out.unionByName(df)
    if out is None:
        return Linkset.empty(model.df.sparkSession).df.select(*_OUT, F.lit(None).cast("string").alias("_by"))
    return out


def _deduplicated(rows: DataFrame, known: DataFrame | None = None) -> Linkset:
    """One deduplication of all links made in a stage; without those that create an entity that is ``known``."""
    if known is not None:
        rows = rows.join(known.select(F.col("out_rid").alias("_known")), F.col("_by") == F.col("_known"), "left_anti")
    return Linkset(rows.withColumn("link_id", F.lit(None).cast("bigint")).select("link_id", *_OUT)).unique()


def _collected(env: Env, model: Linkset) -> Linkset:
    return _deduplicated(_rows(env, model))


def _rules(rule) -> list:
    return list(rule) if isinstance(rule, (list, tuple)) else [rule]


class Pipeline:
    """Three kinds of rules. Fingerprint: type -> action(s) that materialize. Transform: rel, or (rel, output type, ...) ->
    action. Labelize: output type -> action whose values are labels. ``id_helper`` makes the id of an entity from columns
    of its type and its fingerprint's keys and values (two parallel arrays)."""

    def __init__(self, fingerprint_rules: Mapping, transform_rules: Mapping | None = None, labelize_rules: Mapping | None = None, base: str | None = None, extras: Mapping | None = None, hooks: Sequence[Callable[[DataFrame], Linkset]] = (), label_rel: str = LABEL, id_helper=None):
        self.fingerprint_rules, self.transform_rules, self.labelize_rules = fingerprint_rules, transform_rules or {}, labelize_rules or {}
        self.base, self.extras, self.hooks, self.label_rel, self.id_helper = base, extras or {}, hooks, label_rel, id_helper

    def _env(self, model: Linkset, **more) -> Env:
        return Env(model, base=self.base, extras=self.extras, id_helper=self.id_helper, **more)

    def fingerprint(self, model: Linkset) -> tuple[DataFrame, DataFrame]:
        """(links with the entities they create, fingerprints), both written."""
        env, mains = self._env(model), []
        typed = model.match(None, TYPE).df
        for typ, rules in self.fingerprint_rules.items():
            for rule in _rules(rules):
                ctx = typed.where(F.col("target") == typ).select(F.col("origin").alias("in_rid"), "origin", F.lit(None).cast("string").alias("rel"), "target", F.lit(True).alias("target_is_iri"), F.expr(NO_ATTRS).alias("attrs")).distinct()
                df, ids = _action(rule).lower(_contexts(ctx), env)
                mains.append(df.select(F.col("_in").alias("in_rid"), F.explode(ids).alias("out_rid")).withColumn("is_main", F.lit(True)))
        rows = None
        for df in [*mains, *[m.withColumn("is_main", F.lit(False)) for m in env.made]]:
            rows = df if rows is None else rows.unionByName(df)
        if rows is None:
            rows = model.df.sparkSession.createDataFrame([], "in_rid string, out_rid string, is_main boolean")
        fingerprints = cut(rows.groupBy("in_rid", "out_rid").agg(F.max("is_main").alias("is_main")))
        return cut(_rows(env, model)), fingerprints

    def dispatched(self, model: Linkset, made: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, dict]:
        """The contexts of all transform rules from one join of the links with the fingerprints, written once, and for each rule's
        key the condition by which it takes its own of them."""
        keys = {k: (k, None) if isinstance(k, str) else (k[0], list(k[1:])) for k in self.transform_rules}
        types = made.where(F.col("rel") == TYPE).groupBy(F.col("origin").alias("_to")).agg(F.collect_set("target").alias("types"))
        outs = fingerprints.join(types, F.col("out_rid") == F.col("_to"), "left").select("in_rid", "out_rid", "is_main", "types")
        links = model.match(None, {r for r, _ in keys.values()}).df if keys else model.df.limit(0)
        table = cut(links.join(outs, F.col("origin") == F.col("in_rid")).select("in_rid", F.col("out_rid").alias("origin"), "rel", "target", "target_is_iri", "attrs", "is_main", "types"))
        mine = {}
        for k, (r, kinds) in keys.items():
            gate = F.col("is_main") if kinds is None else F.coalesce(F.arrays_overlap("types", F.array(*[F.lit(t) for t in kinds])), F.lit(False))
            mine[k] = (F.col("rel") == r) & gate
        return table, mine

    def transform(self, model: Linkset, made: DataFrame, fingerprints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(links with the entities they create, entities made, misses, firings)."""
        spark = model.df.sparkSession
        resources = fingerprints.where("is_main").groupBy("in_rid").agg(F.array_sort(F.collect_list("out_rid")).alias("mains"))
        env = self._env(model, resources=resources)
        table, mine = self.dispatched(model, made, fingerprints)
        for key, rules in self.transform_rules.items():
            for rule in _rules(rules):
                first = _contexts(table.where(mine[key])).withColumn("_input", F.array("_in"))
                _action(rule).lower(first, replace(env, vars={"input-resource": "_input"}))
        misses = model.df.join(fingerprints.select("in_rid").distinct(), F.col("origin") == F.col("in_rid"), "left_semi")
        fired = spark.createDataFrame([], "rule string, n bigint")
        if mine:
            any_rule = F.lit(False)
            for c in mine.values():
                any_rule |= c
            taken = table.where(any_rule).select(F.col("in_rid").alias("_mo"), F.col("rel").alias("_mr")).distinct()
            misses = misses.join(taken, (F.col("origin") == F.col("_mo")) & (F.col("rel") == F.col("_mr")), "left_anti")
            counts = [F.struct(F.lit(k if isinstance(k, str) else " ".join(k)).alias("rule"), (F.count_if(c) * len(_rules(self.transform_rules[k]))).alias("n")) for k, c in mine.items()]
            fired = table.agg(F.array(*counts).alias("all")).select(F.explode("all").alias("f")).select("f.*")
        entities = None
        for m in env.made:
            entities = m if entities is None else entities.unionByName(m)
        if entities is None:
            entities = fingerprints.limit(0).select("in_rid", "out_rid")
        return cut(_rows(env, model)), entities, misses, fired

    def labelize(self, output: Linkset) -> tuple[Linkset, DataFrame]:
        env, rows = self._env(output), None
        for typ, rules in self.labelize_rules.items():
            for rule in _rules(rules):
                ctx = output.match(None, TYPE, typ).df.select(F.col("origin").alias("in_rid"), "origin", "rel", "target", "target_is_iri", "attrs").distinct()
                df, c = _action(rule).lower(_contexts(ctx), env)
                part = df.select("_o", F.col("_t").alias("type"), F.explode(c).alias("label"))
                rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            spark = output.df.sparkSession
            return Linkset.empty(spark), spark.createDataFrame([], "origin string, type string")
        rows = rows.withColumn("label", F.trim("label"))
        good = rows.where("label <> ''")
        labels = Linkset.from_columns(good, F.col("_o"), F.lit(self.label_rel), F.col("label"), None, F.lit(False))
        return labels, rows.where("label = ''").select(F.col("_o").alias("origin"), "type").distinct()

    def run(self, model: Linkset, known: DataFrame | None = None) -> Result:
        """The stages in order. ``known`` (out_rid): entities of earlier runs, which are not created again: their type, fingerprint
        and own links are left out, but what transform rules say of them is not."""
        spark = model.df.sparkSession
        made, fingerprints = self.fingerprint(model)
        none = spark.createDataFrame([], "origin string, type string")
        if not fingerprints.limit(1).count():
            return Result(Linkset.empty(spark), fingerprints, model.df.limit(0), none, False)
        more, entities, misses, firings = self.transform(model, made, fingerprints)
        rows = made.unionByName(more)
        output = Linkset(cut(_deduplicated(rows).df))
        labels, blank = self.labelize(output)
        ids = fingerprints.select("out_rid").unionByName(entities.select("out_rid")).distinct()
        if known is not None:
            output = _deduplicated(rows, known)
        output = output.union(labels, *[hook(ids) for hook in self.hooks])
        return Result(output, fingerprints, misses, blank, True, firings, ids)


def stage(key: int):
    """Marks a method of a ``Definition`` as the stage with that place in the order."""

    def mark(method):
        method.stage_key = key
        return method

    return mark


class Definition:
    """A pipeline of one's own: methods marked with ``@stage(n)`` are run in the order of n, each seeing ``self.model`` and
    adding to ``self.output``. One that returns False ends the run."""

    def __init__(self):
        self.model: Linkset | None = None
        self.output: Linkset | None = None

    def stages(self) -> list[Callable]:
        found = [getattr(self, n) for n in dir(type(self)) if hasattr(getattr(type(self), n), "stage_key")]
        return sorted(found, key=lambda m: (m.stage_key, m.__name__))

    def run(self, model: Linkset, output: Linkset | None = None) -> Linkset:
        self.model, self.output = model, output or Linkset.empty(model.df.sparkSession)
        for method in self.stages():
            if method() is False:
                break
        return self.output


__all__ = [n for n in dir() if not n.startswith("_")] + ["resolve"]
