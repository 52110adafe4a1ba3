"""Personal information in free text: found by a skip-chain conditional random field, replaced by typed placeholders.

Every line becomes a chain of token classes; lines of the same classes are worked once. Tokens that occur again
in the document are joined by skip edges to one node for all mentions, and loopy message passing brings their labels into
agreement, so that a name that is clear in one place is found in all others.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain as chained

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from linkframe.llm.crf import Crf
from linkframe.llm.names import MARKS, fold
from linkframe.llm.pii_lexer import STREETS, alike, joined, line_classes, segments, token_spans, token_texts, tokens
from linkframe.llm.pii_training import LABELS, NUMBER, Grammar, label

#: Lines drawn from the grammar for training; the bound of the training sample.
TRAINING_LINES = 12_000
ROUNDS = 90
#: Log potential of two mentions having the same type.
AGREEMENT = 1.2
#: Mentions disagree if their beliefs differ by more than this.
UNEQUAL = 0.02
#: The belief in an address from which on a line with a street is looked at together with the lines after it.
POSSIBLE = 0.001
PERSON, ADDRESS = (NUMBER["B-PERSON"], NUMBER["I-PERSON"]), (NUMBER["B-ADDRESS"], NUMBER["I-ADDRESS"])
KIND = {NUMBER["EMAIL"]: "email", NUMBER["PHONE"]: "phone", NUMBER["IDNUM"]: "idnum"} | dict.fromkeys(PERSON, "person") | dict.fromkeys(ADDRESS, "address")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[IDNUM]", "person": "[PERSON]", "address": "[ADDRESS]"}
#: Kept per worker: so many places of chains already met, by their classes.
MOST_PLACES = 2_000_000
MOST_WINDOWS = 200_000
#: Lines of up to LONG_LINE characters are kept with their chains, about so many; a batch begins anew when there are more.
MOST_LINES = 200_000
LONG_LINE = 400
#: Rows and bytes of text that are worked at once.
MOST_ROWS = 2000
MOST_BYTES = 32 << 20
#: So many words of a document are sought in its text before its lines are read; more would take longer than reading them.
MOST_SOUGHT = 40


@lru_cache(maxsize=200_000)
def folded(w: str) -> str:
    return w.lower() if w.isascii() else fold(w)



def windows(classes: tuple) -> list[tuple]:
    """Of every token, the classes from four before to three after it."""
    c = ("^^", "^^", "^^", "^^", *classes, "$$", "$$", "$$")
    return list(zip(c, c[1:], c[2:], c[3:], c[4:], c[5:], c[6:], c[7:]))


def features(window: tuple) -> list:
    """Features of a token: classes around it, and pairs of them."""
    e, d, a, b, x, y, z, f = window
    short = x.split("|")[0]
    return [(0, x), (1, b), (2, y), (3, a), (4, z), (5, d), (6, f), (7, b, short), (8, short, y), (9, a, b, short), (10, short, y, z), (11, b, short, y), (12, d, a, b), (13, e, short), (14, short)]


def templates(classes: tuple) -> list[list]:
    """Features of every token."""
    return [features(w) for w in windows(classes)]


KINDS_OF = [KIND.get(i, "") for i in range(len(LABELS))]


def same_type() -> np.ndarray:
    """Log potential of a mention and the node of all mentions: with it, two mentions agree by AGREEMENT through the node."""
    k, t = len(set(KINDS_OF)), np.exp(AGREEMENT)
    x = t + np.sqrt(t * t + t * (k - 2) - (k - 1))  # x² + k - 1 = t (2 x + k - 2)
    return np.array([[np.log(x) if a == b else 0.0 for b in KINDS_OF] for a in KINDS_OF])


def train_model(lines: int = TRAINING_LINES, rounds: int = ROUNDS, seed: int = 5) -> Crf:
    grammar, data = Grammar(seed), {}
    for _ in range(lines):
        text, items = grammar.line()
        spans, classes = tokens(text)
        if spans:
            key = (classes, label(spans, items))
            data[key] = data.get(key, 0.0) + 1.0
    model = Crf(LABELS, templates)
    model.train({k: min(v, 6.0) for k, v in data.items()}, rounds)
    return model


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return train_model()


class Chain:
    """What is known of a chain by its classes: beliefs, whether it has a label, and the places that skip edges join."""

    def __init__(self, classes: tuple, belief: np.ndarray):
        self.classes = classes
        self.belief = belief.astype(np.float32)
        self.labelled = bool((belief.argmax(axis=1) > 0).any())
        self.joint = [i for i, c in enumerate(classes) if c in ("Xx", "XX", "GIVEN", "CNAME", "CODE", "EMAIL") or c[0] == "M"]
        #: A line with a street or box that may be an address; the lines after it can make it one only if it is not ruled out.
        self.goes_on = not STREETS.isdisjoint(classes) and bool(belief[:, ADDRESS].max() > POSSIBLE)
        #: Of clear places, whose beliefs in any item are together less than makes mentions disagree, no two do.
        self.unclear = [i for i in self.joint if 1 - belief[i, 0] > 0.98 * UNEQUAL]


class Finder:
    """One worker's model, with the chains it has met."""

    def __init__(self, model: Crf):
        self.model, self.same = model, same_type()
        # The node of all mentions prefers no kind: it has no start, and the labels of a kind share its weight.
        self.hub = -model.start[None, :] - np.log([[KINDS_OF.count(x) for x in KINDS_OF]])
        self.known: dict[tuple, Chain] = {}
        self.places = 0
        self.lines: dict[str, Chain | None] = {}
        self.rows: dict[tuple, np.ndarray] = {}

    def nodes(self, classes: tuple) -> np.ndarray:
        """``model.nodes``; windows of classes come again in other chains."""
        return np.array([self.rows[w] for w in windows(classes)])

    def weigh(self, chains: list[tuple]) -> None:
        """Have the potentials of all windows of the chains at hand."""
        if len(self.rows) > MOST_WINDOWS:
            self.rows.clear()
        new = list({w for c in chains for w in windows(c)}.difference(self.rows))
        if new:
            get = self.model.index.get
            of = np.array([[get(f, 0) for f in features(w)] for w in new])
            self.rows.update(zip(new, np.einsum("ijk->ik", self.model.weights[of])))

    def learn(self, chains: set[tuple]) -> None:
        if self.places > MOST_PLACES:
            self.known.clear()
            self.places = 0
        new = [c for c in chains if c not in self.known]
        self.weigh(new)
        for c, b in zip(new, self.model.beliefs([self.nodes(c) for c in new])):
            self.known[c] = Chain(c, b)
            self.places += len(c)

    def chains(self, texts: list[str | None]) -> list[list[tuple[int, int, Chain]]]:
        """Of every text, the chains of its lines. A line is looked up as it is written, once: the classes of a long line are as long
        as it is, and so is their hash."""
        if len(self.lines) > MOST_LINES:
            self.lines.clear()
        docs = [alike(t).split("\n") if t else [] for t in texts]
        new = {line: line_classes(line) for line in set(chained.from_iterable(docs)).difference(self.lines)}
        self.learn(set(new.values()) - {()})
        self.lines.update((line, self.known[c] if c else None) for line, c in new.items())
        out = [segments(d, self.lines) for d in docs]
        for line in new:
            if len(line) > LONG_LINE:
                del self.lines[line]
        return out

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Of every text, the items (start, end, kind)."""
        docs = self.chains(texts)
        more = {k: joined(texts[k], d, lambda c: c.goes_on, lambda c: c.classes) for k, d in enumerate(docs) if any([c.goes_on for *_, c in d])}
        self.learn({c for d in more.values() for *_, c in d if isinstance(c, tuple)})
        for k, d in more.items():
            docs[k] = [(start, end, self.known[c] if isinstance(c, tuple) else c) for start, end, c in d]
        nodes, first, edges, place = [], [], [], {}
        groups_of = [self.groups(texts[k], chains) if any(c.unclear for *_, c in chains) else [] for k, chains in enumerate(docs)]
        self.weigh([docs[k][n][2].classes for k, groups in enumerate(groups_of) for n in {n for g in groups for n, _ in g}])
        first_of_hub = np.exp(self.hub + self.model.start)
        first_of_hub /= first_of_hub.sum()
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for k, chains in enumerate(docs):
            for mentions in groups_of[k]:
                hub = len(nodes)
                nodes.append(self.hub)
                first.append(first_of_hub)
                for n, i in mentions:
                    if (k, n) not in place:
                        place[k, n] = len(nodes)
                        nodes.append(self.nodes(chains[n][2].classes))
                        first.append(chains[n][2].belief)
                    edges.append((place[k, n], i, hub, 0))
        agreed = self.model.loopy(nodes, first, np.array(edges), self.same) if edges else first
        for k, chains in enumerate(docs):
            if groups_of[k]:
                told = [(x, agreed[place[k, n]] if (k, n) in place else x[2].belief) for n, x in enumerate(chains) if (k, n) in place or x[2].labelled]
            else:
                told = [(x, x[2].belief) for x in chains if x[2].labelled]
            for (start, end, c), belief in told:
                out[k] += decode(token_spans(texts[k], start, end, c.classes), c.classes, belief)
        return out

    def groups(self, text: str, chains: list[tuple[int, int, Chain]]) -> list[list[tuple[int, int]]]:
        """The mentions (chain, place) of every word that stands again, of the parts of the document (chains that words join) in
        which mentions of some word disagree. In other parts there is nothing to bring into agreement."""
        words = Words(text, chains)
        # A word of clear mentions alone, or one that stands nowhere else, cannot disagree: only others are looked for in all lines.
        doubtful = {w for n, (*_, c) in enumerate(chains) if c.unclear for w in words.of(n, c.unclear)}
        keys = None  # of many words, all lines are read
        if len(doubtful) <= MOST_SOUGHT:
            whole = bare(text)
            sought = {w: k for w, k in ((w, bare(w)) for w in doubtful) if whole.count(k) > 1}
            doubtful, keys = set(sought), set(sought.values())
        if not doubtful:
            return []
        by: dict[str, list[tuple[int, int]]] = {}
        for n, (start, end, chain) in enumerate(chains):
            if chain.joint and (keys is None or holds(bare(text[start:end]), keys)):
                for w, i in zip(words.of(n, chain.joint), chain.joint):
                    if w in doubtful:
                        by.setdefault(w, []).append((n, i))
        shared = [(w, g) for w, g in by.items() if len(g) > 1]
        if not shared:
            return []
        rows = np.array([chains[n][2].belief[i] for _, g in shared for n, i in g])
        starts = np.cumsum([0, *[len(g) for _, g in shared]])[:-1]
        apart = (np.maximum.reduceat(rows, starts) - np.minimum.reduceat(rows, starts)).max(axis=1)
        differ = [w for (w, _), far in zip(shared, apart) if far > UNEQUAL]
        if not differ:
            return []
        by = {}
        for n, (*_, chain) in enumerate(chains):
            for w, i in zip(words.of(n, chain.joint), chain.joint):
                by.setdefault(w, []).append((n, i))
        groups = [g for g in by.values() if len(g) > 1]
        root = list(range(len(chains)))

        def top(n: int) -> int:
            while root[n] != n:
                root[n] = n = root[root[n]]
            return n

        for g in groups:
            for n, _ in g[1:]:
                root[top(n)] = top(g[0][0])
        parts = {top(by[w][0][0]) for w in differ}
        return [g for g in groups if top(g[0][0]) in parts]


@lru_cache(maxsize=1)
def finder_of(model: Crf) -> Finder:
    """One finder a worker process, for all its tasks."""
    return Finder(model)


class Words:
    """The words at places of the chains of a document, as mentions share them; a chain is read when it is first asked for."""

    def __init__(self, text: str, chains: list[tuple[int, int, Chain]]):
        self.text, self.chains = text, chains
        self.read: dict[int, list[str]] = {}

    def of(self, n: int, places: list[int]) -> list[str]:
        if not places:
            return []
        start, end, chain = self.chains[n]
        if n not in self.read:
            self.read[n] = token_texts(self.text[start:end], chain.classes)
        words, classes = self.read[n], chain.classes
        return [folded(words[i]) if classes[i] != "CODE" else words[i] for i in places]


_MARKED = [(chr(c), to) for c, to in MARKS.items()]


def bare(text: str) -> str:
    """The ASCII letters of ``fold(text)``, without looking at each: words that are folded alike are bare alike, and a text holds the
    bare form of each of its words."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.lower())
    for c, to in _MARKED:
        if c in text:
            text = text.replace(c, to)
    return text.encode("ascii", "ignore").decode()


def holds(text: str, keys: set[str]) -> bool:
    for k in keys:
        if k in text:
            return True
    return False


def decode(spans: list[tuple[int, int]], classes: tuple, belief: np.ndarray) -> list[tuple[int, int, str]]:
    """Items of a chain: each token's most likely label; B or I of one kind next to each other are one item, unless a B
    follows a complete one."""
    best = belief.argmax(axis=1)
    out, i, n = [], 0, len(best)
    while i < n:
        kind = KIND.get(int(best[i]), "")
        if not kind:
            i += 1
            continue
        j = i + 1
        if kind in ("person", "address"):
            inside = (PERSON if kind == "person" else ADDRESS)[1]
            while j < n and best[j] == inside:
                j += 1
        a, b = i, j
        while b > a and classes[b - 1] in ",;:()NL.-" and not (b - a > 1 and classes[b - 1] == "." and classes[b - 2] == "I"):
            b -= 1
        while a < b and classes[a] in ",;:().-NL":
            a += 1
        if a < b and (kind != "person" or whole_name(classes[a:b])):
            out.append((spans[a][0], spans[b - 1][1], kind))
        i = j
    return out


def whole_name(classes: tuple) -> bool:
    """A full name, or initials and a surname: a surname or a given name alone is no item."""
    if "CNAME" in classes:
        return True
    words = [c for c in classes if c in ("Xx", "XX", "X2", "Xx-", "GIVEN", "I", "STREETX") or c.isupper() and len(c) > 2 and c != "NL"]
    return len(words) > 1 and any(c != "I" for c in words)


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most MOST_ROWS rows and, but for single longer texts, MOST_BYTES of text: what is at hand of them at once is some times their size."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(size):
        if i > start and (i - start == MOST_ROWS or held + n > MOST_BYTES):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(size):
        yield batch.slice(start)


def _run(shared, how: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = finder_of(shared.value)
        for b in batches:
            for part in parts_of(b):
                texts = part.column(1).to_pylist()
                found = finder.find(texts)
                if how == "redact":
                    done = [redacted(t, f) for t, f in zip(texts, found)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(done, pa.string()), pa.array([len(f) for f in found], pa.int64())], ["id", "text", "n_items"])
                else:
                    rows = [sorted({(k, texts[i][s:e]) for s, e, k in f}) for i, f in enumerate(found)]
                    at = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
                    flat = [x for r in rows for x in r]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array([k for k, _ in flat], pa.string()), pa.array([m for _, m in flat], pa.string())], ["id", "kind", "matched"])

    return run


def redacted(text: str | None, items: list[tuple[int, int, str]]) -> str | None:
    if not items:
        return text
    out, at = [], 0
    for s, e, kind in sorted(items):
        if s >= at:
            out += [text[at:s], PLACEHOLDER[kind]]
            at = e
    return "".join([*out, text[at:]])


def _mapped(documents: DataFrame, how: str, schema: str, id_col: str, text_col: str, model: Crf | None) -> DataFrame:
    kind = documents.schema[id_col].dataType
    shared = documents.sparkSession.sparkContext.broadcast(model or default_model())
    rows = documents.select(id_col, text_col)
    return rows.mapInArrow(_run(shared, how, None), f"id {kind.simpleString()}, {schema}").withColumnRenamed("id", id_col)


def find_items(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """(id, kind, matched): each different item of a document once; ``matched`` is the exact substring. kind is 'person',
    'email', 'phone', 'idnum' or 'address'. Null, empty and blank texts have none; whole texts are read, however long.
    Rows are independent: a repeated row gives its items again. No shuffle; the model is of bounded size and broadcast."""
    return _mapped(documents, "find", "kind string, matched string", id_col, text_col, model)


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """(id, text, n_items): the text with a typed placeholder for each item and everything else unchanged; null stays null."""
    return _mapped(documents, "redact", "text string, n_items bigint", id_col, text_col, model)
