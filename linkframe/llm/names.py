"""Linking the spellings of a name: typos, initials, reordered parts, nicknames, titles, legal forms.

A spelling is read into its parts. Parts that may be misspelt are compared by a pigeonhole segment join: of two strings at
most k edits apart, cut into k+1 segments, at least one segment of the one stands in the other at nearly its place; so
the segments go into an inverted index, every string looks up its position-shifted substrings, and what meets is
verified with a banded edit distance (a swap of neighbours is one edit).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkframe.schema import cut, shuffle_partitions, splittable

# Short forms of given names.
NICKNAMES = {
    "adelaide": "addie", "alexander": "alex sasha sandy", "alexandra": "lexi", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "bartholomew": "bart", "benjamin": "ben", "catherine": "cathy cate",
    "charles": "charlie chuck", "chidimma": "chidi", "christopher": "chris kit", "constance": "connie", "daniel": "dan danny", "deborah": "deb debbie", "dorothea": "dora dot dorothy", "edward": "ned eddie",
    "elizabeth": "liz betty beth lizzie eliza", "francisca": "fran paca", "frederick": "fred freddie", "giuseppina": "pina", "gregory": "greg", "gwendolyn": "gwen", "helena": "lena", "henry": "harry hank", "ignatius": "iggy",
    "isabella": "bella", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jenny", "johannes": "hannes jan", "john": "johnny jack", "jonathan": "jon", "joseph": "joe", "katherine": "kate kathy", "laurentius": "lars",
    "leocadia": "leo", "leonard": "len lenny", "margaret": "maggie peggy meg", "matthew": "matt", "maximilian": "max", "michael": "mike mick", "nicholas": "nick klaus", "oluwaseun": "seun", "ottilie": "tilly",
    "patricia": "pat patty", "peter": "pete", "philippa": "pippa", "quintus": "quin", "rebecca": "becky", "richard": "dick rick rich", "robert": "rob bob bobby", "rosalind": "roz", "samuel": "sam", "stephen": "steve", "susanna": "sue sanna",
    "soren": "soeren", "bjorn": "bjoern", "zoe": "zoee", "theodore": "theo ted", "thomas": "tom tommy", "ursula": "ulla", "veronica": "ronnie", "victoria": "vicky", "wilhelmina": "mina", "william": "bill will billy", "yevgenia": "zhenya", "zacharias": "zach",
}
# Titles, particles of surnames, names that stand for no one.
TITLES = set("sir dame lord lady dr prof professor mr mrs ms miss rev hon mme mlle herr frau dipl ing ph d phd md".split())
PARTICLES = set("van von der den de di da del la le du dos ter ten zu".split())
NO_ONE = set("anonymous anon unknown various".split()) | {"n n", "et al", "n a"}
# Words of publishers' names that say what they are, and words that say nothing.
PUBLISHER_WORDS = {
    "press": "university univ press pr", "house": "publishing publishers publisher publ pub house hse", "edition": "edition editions ed eds", "verlag": "verlag verl", "books": "books bks book",
}
PUBLISHER_STOP = set("the of by and und et co inc ltd limited gmbh kg s a sa messrs company llc corp plc ag".split())
SHORT_WORDS = {"ppr": "paper"}

#: A spelling in several forms follows another only if that one stands in so many times as many.
RARER = 8

FORMAL = {short: formal for formal, shorts in NICKNAMES.items() for short in shorts.split()}
GIVEN = set(NICKNAMES) | set(FORMAL)
KIND = {w: k for k, ws in PUBLISHER_WORDS.items() for w in ws.split()}
MARKS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})


def fold(s: str) -> str:
    """Lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()).translate(MARKS) if not unicodedata.combining(c))


def edits(a: str, b: str, most: int) -> int:
    """Edits between a and b (insert, delete, replace, swap of neighbours), or most + 1 when there are more; only the
    band of ``most`` diagonals is worked."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    far = most + 1
    before, last = None, [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        row = [far] * (m + 1)
        if i <= most:
            row[0] = i
        lo, hi = max(1, i - most), min(m, i + most)
        for j in range(lo, hi + 1):
            v = last[j - 1] + (a[i - 1] != b[j - 1])
            v = min(v, last[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, before[j - 2] + 1)
            row[j] = v
        if min(row) > most:
            return far
        before, last = last, row
    return min(last[m], far)


def allowed(*lengths: int) -> int:
    """Edits at which names of these lengths still are one: short names differ by a letter and mean others."""
    n = min(lengths)
    return 2 if n >= 7 else 1 if n >= 4 else 0


def read_author(name: str) -> tuple[str, str, str, bool] | None:
    """(surname, given, further initials, sure), all folded; sure: which part is the surname follows from the form. Given
    is one letter where only an initial stands. None where no name can be read or no one is meant."""
    s = re.sub(r"[(\[].*?[)\]]", " ", name)
    s = re.sub(r"\s+", " ", s).strip(" .;:")
    if fold(s).replace(".", "") in NO_ONE or not s:
        return None
    comma = "," in s
    parts = [re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", x) for x in s.split(",", 1)]
    titled = False

    def clean(words: list[str]) -> list[str]:
        nonlocal titled
        kept = [w for w in words if fold(w) not in TITLES or (len(w) < 3 and w.isupper())]
        titled |= len(kept) < len(words)
        return kept

    parts = [clean(p) for p in parts]
    initials = lambda w: len(w) == 1 or (len(w) <= 3 and w.isupper() and not re.search("[AEIOUY]", w[1:-1]) and any(len(x) > 3 for p in parts for x in p))
    if comma and parts[0] and len(parts) > 1 and parts[1]:
        last, rest, sure = parts[0], parts[1], True
    else:
        words = [w for p in parts for w in p]
        if len(words) < 2:
            return (fold(words[0]), "", "", False) if words and len(words[0]) > 1 else None
        if initials(words[-1]) and not initials(words[0]):  # Surname I
            n = next(i for i, w in enumerate(words) if initials(w))
            last, rest, sure = words[:n], words[n:], True
        else:
            n = len(words) - 1
            while n > 1 and fold(words[n - 1]) in PARTICLES:
                n -= 1
            last, rest = words[n:], words[:n]
            sure = titled or any(initials(w) for w in rest) or n < len(words) - 1
    if initials(rest[0]):
        given, more = fold(rest[0])[0], fold(rest[0])[1:] + "".join(fold(w)[0] for w in rest[1:])
    else:
        given, more = fold(rest[0]), "".join(fold(w)[0] for w in rest[1:])
    return fold(" ".join(last)), given, more, sure


def formal(given: str) -> str:
    return FORMAL.get(given, given)


def read_publisher(name: str) -> tuple[str, str] | None:
    """(kind, own words in order), folded. None where nothing of its own is left."""
    words = re.findall(r"[^\W_]+", fold(name))
    if not words or " ".join(words) in NO_ONE:
        return None
    kind, own = "", []
    if len(words) > 2 and words[-2:] == ["u", "p"]:
        words, kind = words[:-2], "press"
    elif len(words) > 1 and words[-1] == "up":
        words, kind = words[:-1], "press"
    first = True
    for w in words:
        w = SHORT_WORDS.get(w, w)
        if w in PUBLISHER_STOP:
            continue
        k = KIND.get(w)
        if k is None and len(w) >= 5:
            k = next((v for x, v in KIND.items() if len(x) >= 5 and edits(w, x, 1) <= 1), None)
        if k is None:
            tail = next((x for x in KIND if len(x) >= 5 and w.endswith(x) and len(w) - len(x) >= 3), None)
            if tail:
                k, w = KIND[tail], w[: -len(tail)].rstrip("-")
                own.append(w)
            else:
                own.append(w)
        if k and (first or k == "press" or kind in ("", "books")):
            kind, first = k, False
    if not own:
        return None
    if not kind:
        kind = "pair" if len(own) > 1 else "plain"
    return kind, " ".join(sorted(own))


_NODE = "surname string, given string, more string, sure boolean"


def _read(kind: str):
    def run(names: pd.Series) -> pd.DataFrame:
        rows = []
        for n in names:
            got = read_author(n) if kind == "author" else read_publisher(n)
            if got is None:
                rows.append((None, None, None, None))
            else:
                rows.append(got if kind == "author" else (got[1], got[0], "", True))
        return pd.DataFrame(rows, columns=["surname", "given", "more", "sure"])

    return F.pandas_udf(run, _NODE)


def _oriented(names: DataFrame) -> DataFrame:
    """Where the form leaves open which part is the surname: by how often either part is one or the other elsewhere."""
    sure = names.where("sure and given <> ''")
    as_given = sure.where("length(given) > 1").groupBy(F.col("given").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    as_last = sure.groupBy(F.col("surname").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    seen = lambda df, c, n: splittable(df, "w").select(F.col("w").alias(c), F.col("n").alias(n))
    open_ = names.where("not sure and given <> ''")
    open_ = open_.join(seen(as_given, "given", "gg"), "given", "left").join(seen(as_given, "surname", "sg"), "surname", "left")
    open_ = open_.join(seen(as_last, "surname", "ss"), "surname", "left").join(seen(as_last, "given", "gs"), "given", "left")
    known = F.array(*[F.lit(g) for g in sorted(GIVEN)])
    score = lambda given, last, c: F.least(F.coalesce(given, F.lit(0)), F.lit(20)) + F.least(F.coalesce(last, F.lit(0)), F.lit(5)) + F.when(F.array_contains(known, F.col(c)), 30).otherwise(0)
    flip = score(F.col("sg"), F.col("gs"), "surname") > score(F.col("gg"), F.col("ss"), "given")
    open_ = open_.select("name", F.when(flip, F.col("given")).otherwise(F.col("surname")).alias("surname"), F.when(flip, F.col("surname")).otherwise(F.col("given")).alias("given"), "more")
    return names.where("sure or given = ''").select("name", "surname", "given", "more").unionByName(open_)


def _allowed(n: Column) -> Column:
    """``allowed`` of one length."""
    return F.when(n >= 7, 2).when(n >= 4, 1).otherwise(0)


def cuts(n: int, parts: int) -> list[tuple[int, int]]:
    """Segments (start, length) of a text of length n, nearly equal."""
    size, more = divmod(n, parts)
    lengths = [size + (i >= parts - more) for i in range(parts)]
    return [(sum(lengths[:i]), length) for i, length in enumerate(lengths)]


@lru_cache(maxsize=4096)
def _places(n: int, most: int, longer: int, own: bool = False) -> list[tuple[str, int, int, bool]]:
    """Where the segments of a text of length n stand in one that is ``longer`` by so much, and as few edits away as length n
    allows: (key head, start, end, whether the letters count in any order); ``own``: in that text itself.

    Some segment i is without edit such that i edits are before it and the rest, k - i, after it; so it is shifted by at most i, and what
    it is shifted by differs from ``longer`` by at most k - i. A swap across the border of two segments spoils both and counts once:
    then the two together keep their letters, or, after two such swaps, the whole text does."""
    k = min(most, allowed(n))
    if n < 1 or longer > k:
        return []
    parts, out = cuts(n, k + 1), []
    for i, (p, length) in enumerate(parts):
        out += [(f"{n},{i},", p + d, p + d + length, False) for d in (range(-i, i + 1) if not own else [0]) if abs(longer - d) <= k - i and p + d >= 0 and p + d + length <= n + longer]
    if k == 2 and longer < 2:
        (_, _), (second, _), (third, _) = parts
        out += [(f"{n},<,", 0, third, True), (f"{n},>,", second + longer, n + longer, True)]
    if k and not longer:
        out.append((f"{n},*,", 0, n, True))
    return out


def _keys(s: str, places: list[tuple[str, int, int, bool]]) -> set[str]:
    return {head + ("".join(sorted(s[a:b])) if loose else s[a:b]) for head, a, b, loose in places}


def index_keys(s: str, most: int) -> set[str]:
    """Keys of the segments of a text: its length, the segment, its letters. ``most``: edits looked for; a text allows no more
    than its length does. Of seven letters or more there are three segments, of four or more two, so none is shorter than
    two letters, and shorter texts are one."""
    return _keys(s, _places(len(s), most, 0, True))


def probe_keys(s: str, most: int) -> set[str]:
    """Keys of texts not longer than this one that it is as few edits from as they allow."""
    return set().union(*[_keys(s, _places(len(s) - longer, most, longer)) for longer in range(most + 1)])


_KEYED = "key bigint, text string, block string"


def _keyed(keys, most: int):
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                found, counts = [], []
                for s, block in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    seed = xxhash.xxh64_intdigest(block)
                    own = [xxhash.xxh64_intdigest(k, seed) for k in keys(s, most)]
                    found += own
                    counts.append(len(own))
                at = pa.array(np.repeat(np.arange(len(counts)), counts))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64)), part.column(0).take(at), part.column(1).take(at)], ["key", "text", "block"])

    return run


def segment_join(probes: DataFrame, index: DataFrame, most: int, blocks: bool = True) -> DataFrame:
    """Pairs (a_text, b_text, block) of ``probes`` and ``index`` (text, and block if ``blocks``), of which the first is the longer or of equal length,
    that are at most as many edits apart as both lengths and ``most`` allow; equal texts among them. Both sides should be
    distinct. Candidates are pairs that share a segment; each is verified."""
    # A small table may be one file, its keys are many: it is spread before them.
    plain = lambda df: df.select("text", (F.col("block") if blocks else F.lit("")).alias("block")).repartition(shuffle_partitions(df.sparkSession))
    a = plain(probes).mapInArrow(_keyed(probe_keys, most), _KEYED).select("key", F.col("text").alias("a_text"), F.col("block").alias("a_block"))
    b = plain(index).mapInArrow(_keyed(index_keys, most), _KEYED).select("key", F.col("text").alias("b_text"), F.col("block").alias("b_block"))
    near = a.join(b, "key").where((F.col("a_block") == F.col("b_block")) & (F.expr(f"levenshtein(a_text, b_text, {2 * most})") >= 0))  # a swap counts twice there
    near = cut(near.select("a_text", "b_text", F.col("a_block").alias("block")).distinct())
    limit = F.least(F.lit(most), _allowed(F.least(F.length("a_text"), F.length("b_text"))))
    near = near.withColumn("most", limit).withColumn("sure", F.expr("levenshtein(a_text, b_text)") <= limit)
    # Only where swaps must count once is the banded distance taken, outside of the JVM.
    close = near.where("sure").unionByName(near.where("not sure").where(_within("a_text", "b_text", "most")))
    return close.select("a_text", "b_text", *(["block"] if blocks else []))


def _within(a: str, b: str, most: str) -> Column:
    """Whether two texts are at most ``most`` edits apart, a swap of neighbours being one."""

    def run(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([edits(s, t, m) <= m for s, t, m in zip(a, b, most)], dtype=bool)

    return F.pandas_udf(run, "boolean")(a, b, most)


def near_texts(texts: DataFrame, most: int, blocks: bool = True) -> DataFrame:
    """(a_text, b_text[, block]): pairs of different ``texts`` (text[, block]) near each other, each once, in one order of the two."""
    return segment_join(texts, texts, most, blocks).where("a_text <> b_text")


def _both_ways(df: DataFrame, *columns: str) -> DataFrame:
    """Every pair in either order: ``columns`` stand for a_... and b_..., the others are of the pair."""
    names = [x for c in columns for x in (("a", "b") if c == "" else (f"a_{c}", f"b_{c}"))]
    rest = [c for c in df.columns if c not in names]
    other = lambda n: ("b" if n[0] == "a" else "a") + n[1:]
    sides = F.array(F.struct(*names), F.struct(*[F.col(other(n)).alias(n) for n in names]))
    return df.select(*rest, F.explode(sides).alias("_s")).select(*rest, "_s.*")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for nodes that have an edge (a, b). Least labels spread
    along edges and jump to the label of their label, so a chain halves every round; each round is a written table, and the
    rounds end when no label moves (labels only become less, so they do)."""
    both = cut(_both_ways(edges.select("a", "b"), "").where("a <> b").distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
        new = cut(jump.select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        moved = new.where("old <> root").limit(1).count()
        label = new.select("node", "root")
        if not moved:
            return label


def _parents(pairs: DataFrame) -> DataFrame:
    """(a, b): every name with a better one near it and the nearest of these. A misspelling is made once, on one form of a
    name, so a spelling that stands in several forms (reordered, abbreviated, in capitals) is a name of its own unless the
    other is far more common (RARER times): two such are two names, however near, and nothing between them joins them, as
    each name follows one other only."""
    d = F.expr("levenshtein(a_text, b_text) + levenshtein(a_given, b_given)")
    both = _both_ways(pairs.select("a", "b", "a_forms", "b_forms", d.alias("d")), "", "forms")
    up = both.where(f"not (a_forms > 1 and b_forms > 1 and b_forms < {RARER} * a_forms) and (b_forms > a_forms or (b_forms = a_forms and b < a))")
    return up.groupBy("a").agg(F.min_by("b", F.struct("d", -F.col("b_forms"), "b")).alias("b"))


def _full_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): full names (text, given, node) that may be one person: the same given name and surnames as many edits apart as
    their length allows, or at most one edit in the surname and the rest of two in the given name."""
    same = near_texts(nodes.select("text", F.col("given").alias("block")).distinct(), 2).withColumnRenamed("block", "given")
    side = lambda x: nodes.select(F.col("text").alias(f"{x}_text"), F.col("given").alias(f"{x}_given"), F.col("node").alias(x))
    same = same.join(side("a").withColumnRenamed("a_given", "given"), ["a_text", "given"]).join(side("b").withColumnRenamed("b_given", "given"), ["b_text", "given"]).select("a", "b")
    texts = nodes.select("text").distinct()
    close = near_texts(texts, 1, False)
    close = close.unionByName(texts.select(F.col("text").alias("a_text"), F.col("text").alias("b_text")))
    other = close.join(side("a"), "a_text").join(side("b"), "b_text").where("a_given <> b_given and levenshtein(a_given, b_given, 4) >= 0")
    # Two known given names are two persons, however alike. An edit in the surname leaves one for the given name.
    known = F.broadcast(nodes.sparkSession.createDataFrame([(g,) for g in sorted(GIVEN)], "g string"))
    for x in "ab":
        other = other.join(known.withColumnRenamed("g", f"{x}_g"), F.col(f"{x}_given") == F.col(f"{x}_g"), "left")
    left = F.least(_allowed(F.least(F.length("a_given"), F.length("b_given"))), F.when(F.col("a_text") == F.col("b_text"), 2).otherwise(1))
    other = cut(other.where("a_g is null or b_g is null").withColumn("most", left))
    other = other.where(_within("a_given", "b_given", "most"))
    return same.unionByName(other.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _initial_pairs(nodes: DataFrame) -> DataFrame:
    """(i, p): names of an initial (given of one letter) and the names, full or not, of that first letter and a surname as near
    as its length allows."""
    first = nodes.withColumn("block", F.substring("given", 1, 1))
    short, every = first.where("length(given) = 1"), first
    s, e = short.select("text", "block").distinct(), every.select("text", "block").distinct()
    pairs = segment_join(s, e, 2).select("block", F.col("a_text").alias("it"), F.col("b_text").alias("pt"))
    pairs = cut(pairs.unionByName(segment_join(e, s, 2).select("block", F.col("b_text").alias("it"), F.col("a_text").alias("pt"))).distinct())
    out = pairs.join(short.select("block", F.col("text").alias("it"), F.col("node").alias("i")), ["block", "it"])
    return out.join(every.select("block", F.col("text").alias("pt"), F.col("node").alias("p")), ["block", "pt"]).where("i <> p").select("i", "p")


def _detailed(pairs: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of nodes with what is known of either."""
    for x in (a, b):
        pairs = pairs.join(nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("text", "given", "forms", "second")]), x)
    return pairs.where(f"{a}_second is null or {b}_second is null or {a}_second = {b}_second").drop(f"{a}_second", f"{b}_second")


def _meant(read: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, to): of spellings with an initial, the one person they can mean: nearest surname first, then one whose second
    initial agrees over one that has none; where several are as good, none."""
    may = pairs.where("length(p_given) <> 1").select(F.col("i").alias("node"), F.col("p").alias("person"), F.expr("levenshtein(i_text, p_text)").alias("d"))
    may = may.join(nodes.select(F.col("node").alias("person"), F.col("root").alias("to")), "person").groupBy("node", "to").agg(F.min("d").alias("d"))
    second = read.where("length(given) > 1 and more <> ''").groupBy(F.col("root").alias("to")).agg(F.collect_set(F.substring("more", 1, 1)).alias("seconds"))  # single letters: of bounded number
    tried = read.where("length(given) = 1").select("name", "node", "more").join(may, "node").join(second, "to", "left")
    own = F.substring("more", 1, 1)
    agrees = (F.col("more") == "") | F.col("seconds").isNull() | F.array_contains("seconds", own)
    e = F.when(F.coalesce(F.array_contains("seconds", own), F.lit(False)) & (F.col("more") != ""), 0).otherwise(1)
    tried = tried.where(agrees).withColumn("e", e)
    best = tried.groupBy("name").agg(F.min(F.struct("e", "d")).alias("m"))
    tied = tried.join(best, "name").where((F.col("e") == F.col("m.e")) & (F.col("d") == F.col("m.d"))).groupBy("name").agg(F.min("to").alias("to"), F.max("to").alias("other"))
    return tied.where("to = other").select("name", "to")


def link_names(names: DataFrame, kind: str, name_col: str = "name") -> DataFrame:
    """(name, entity): every distinct spelling of ``names`` that can be read, with the entity it means; ``kind`` is 'author'
    or 'publisher'. Spellings of one entity share its id, the parts of its first name in order of the letters. Null, empty and
    blank names, names without letters and those that stand for no one are left out; repeated rows count once; an empty table
    gives an empty result.

    Authors: two full names are one person if surname and given name (nicknames read as the formal name) are at most two
    edits apart together, fewer in short ones, second initials do not differ, and not both stand in several forms about as
    often; an initial means the one person of that surname whose given name begins so; where it may mean several, the second
    initial decides, or it is an entity of its own. Publishers: the kind of house must agree, and its own words, in any
    order, be at most two edits apart.
    """
    if kind not in ("author", "publisher"):
        raise ValueError("kind must be 'author' or 'publisher'")
    spelled = cut(names.select(F.col(name_col).alias("name")).where("name is not null").distinct())
    read = cut(spelled.repartition(shuffle_partitions(spelled.sparkSession)).withColumn("r", _read(kind)("name")).select("name", "r.*").where("surname is not null"))
    if kind == "author":
        read = _oriented(read)
        read = read.withColumn("given", F.pandas_udf(lambda s: s.map(formal), "string")("given"))
    read = cut(read.select("name", "surname", "given", "more", F.concat_ws("\x1f", "surname", "given").alias("node")))
    nodes = read.groupBy("node").agg(F.min("surname").alias("text"), F.min("given").alias("given"), F.count(F.lit(1)).alias("forms"), F.max(F.when(F.col("more") != "", F.substring("more", 1, 1))).alias("second"))
    nodes = cut(nodes)
    if kind == "publisher":
        pairs = near_texts(nodes.select("text", F.col("given").alias("block")), 2)
        node = lambda x: F.concat_ws("\x1f", f"{x}_text", "block").alias(x)
        roots = components(_parents(cut(_detailed(pairs.select(node("a"), node("b")), nodes))))
        return read.join(roots, "node", "left").select("name", F.coalesce("root", "node").alias("entity"))
    roots = components(_parents(cut(_detailed(_full_pairs(nodes.where("length(given) <> 1")), nodes))))
    nodes = cut(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    read = cut(read.join(nodes.select("node", "root"), "node").select("name", "node", "root", "given", "more"))
    short = cut(_detailed(_initial_pairs(nodes), nodes, "i", "p"))
    best = _meant(read, short, nodes)
    # Initials that mean no full name: with each other, by surname and first letter.
    alone = components(short.where("length(p_given) = 1").select(F.col("i").alias("a"), F.col("p").alias("b"))).select("node", F.col("root").alias("own"))
    out = read.join(best, "name", "left").join(alone, "node", "left")
    return out.select("name", F.coalesce("to", F.when(F.length("given") == 1, F.col("own")), "root").alias("entity"))


def same_entity_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of spellings of an entity, where they are asked for; ``link_names`` is the
    result of the operator. Spellings are distinct, so a group is as large as the ways one name is written."""
    linked = cut(linked)
    a = linked.select("entity", F.col("name").alias("name_a"))
    return a.join(linked.select("entity", F.col("name").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b")
