"""Byte-level BPE encoding of a corpus, with a segment tree over the ranks of adjacent pairs.

A word's leaves are its adjacent pairs, each with (rank, position); every inner node has the least of its two children,
so the root is the leftmost merge of lowest rank. A merge changes three leaves, and their paths to the root are updated.
The trees of all new words of a batch are worked at once: each step is one numpy operation over all of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabulary lies; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public tokenizer splits a text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = np.int64(1) << 62
POS_BITS = 32
POS_MASK = (np.int64(1) << POS_BITS) - 1
#: Words kept in a worker between batches; beyond it the memory is cleared, which costs time but changes nothing.
MOST_WORDS = 1_500_000
#: Few long words: trees of plain lists are faster than numpy over a handful of rows.
FEW, LONG = 16, 512


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """One worker's encoder: the pair table, and the ids of words met so far."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import regex

        self.find = regex.compile(pattern).findall
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        width = max(ranks.values()) + 1
        self.width = np.int64(width)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * width + b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.start()

    def start(self) -> None:
        self.index: dict[str, int] = {}
        self.pool = np.empty(1 << 16, np.int32)
        self.used = 0
        self.begin = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge."""
        k = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.values[at], NONE)

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of two bytes or more, whose pairs fit in trees of the same number of leaves."""
        n_words = len(words)
        length = np.array([len(w) for w in words])
        longest = int(length.max())
        leaves = 1 << max(0, int(longest - 2).bit_length())
        flat = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(n_words, longest)
        sym = self.byte_id[flat]
        col = np.arange(longest)
        inside = col[None, :] < length[:, None]
        nxt = np.repeat(np.arange(1, longest + 1)[None, :], n_words, 0)
        prv = np.repeat(np.arange(-1, longest - 1)[None, :], n_words, 0)
        tree = np.full((n_words, 2 * leaves), NONE, np.int64)
        r = self.rank(sym[:, :-1], sym[:, 1:])
        r = np.where((r < NONE) & inside[:, 1:], (r << POS_BITS) | col[None, :-1], NONE)
        tree[:, leaves : leaves + longest - 1] = r
        level = leaves >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1
        alive = inside.copy()
        w = np.flatnonzero(tree[:, 1] < NONE)
        while len(w):
            root = tree[w, 1]
            i = root & POS_MASK
            new = root >> POS_BITS
            j = nxt[w, i]
            k = nxt[w, j]
            sym[w, i] = new
            alive[w, j] = False
            nxt[w, i] = k
            has_k = k < length[w]
            prv[w[has_k], k[has_k]] = i[has_k]
            h = prv[w, i]
            has_h = h >= 0
            right = np.full(len(w), NONE)
            ww, kk, ii = w[has_k], k[has_k], i[has_k]
            x = self.rank(new[has_k], sym[ww, kk])
            right[has_k] = np.where(x < NONE, (x << POS_BITS) | ii, NONE)
            ww, hh = w[has_h], h[has_h]
            x = self.rank(sym[ww, hh], new[has_h])
            tree[ww, leaves + hh] = np.where(x < NONE, (x << POS_BITS) | hh, NONE)
            tree[w, leaves + i] = right
            in_tree = j < longest - 1
            tree[w[in_tree], leaves + j[in_tree]] = NONE
            nodes = np.concatenate([leaves + i, leaves + np.minimum(j, longest - 2), leaves + np.maximum(h, 0)])
            three = np.concatenate([w, w, w])
            up = leaves
            while up > 1:
                nodes >>= 1
                up >>= 1
                tree[three, nodes] = np.minimum(tree[three, 2 * nodes], tree[three, 2 * nodes + 1])
            w = w[tree[w, 1] < NONE]
        ids = sym[alive].astype(np.int32)
        return np.split(ids, np.cumsum(alive.sum(1))[:-1])

    def merge_one(self, word: bytes) -> np.ndarray:
        """The same for a single long word."""
        n, width, pairs = len(word), int(self.width), self.pairs
        none = (1 << 62, 0)
        sym = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        leaves = 1 << max(0, (n - 2).bit_length())
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            r = pairs.get(sym[i] * width + sym[i + 1])
            if r is not None:
                tree[leaves + i] = (r, i)
        for v in range(leaves - 1, 0, -1):
            tree[v] = min(tree[2 * v], tree[2 * v + 1])

        def put(i: int, leaf: tuple[int, int]) -> None:
            v = leaves + i
            tree[v] = leaf
            v >>= 1
            while v:
                least = min(tree[2 * v], tree[2 * v + 1])
                if tree[v] == least:
                    return
                tree[v] = least
                v >>= 1

        while tree[1] is not none and tree[1] != none:
            rank, i = tree[1]
            j = nxt[i]
            k = nxt[j]
            sym[i], sym[j], nxt[i] = rank, -1, k
            if j < n - 1:
                put(j, none)
            if k < n:
                prv[k] = i
                r = pairs.get(rank * width + sym[k])
                put(i, none if r is None else (r, i))
            else:
                put(i, none)
            h = prv[i]
            if h >= 0:
                r = pairs.get(sym[h] * width + rank)
                put(h, none if r is None else (r, h))
        return np.array([s for s in sym if s >= 0], np.int32)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            b = word.encode("utf-8", "replace")
            groups.setdefault((len(b) - 2).bit_length() if len(b) > 2 else len(b) - 2, []).append((word, b))
        for size, group in groups.items():
            raw = [b for _, b in group]
            if size == -1:
                ids = [self.byte_id[[b[0]]].astype(np.int32) for b in raw]
            elif 1 << size >= LONG and sum(map(len, raw)) < FEW * max(map(len, raw)):  # by the merges of all against those of the longest
                ids = [self.merge_one(b) for b in raw]
            else:
                step = max(1, (1 << 21) >> max(size, 1))  # bounds the memory of the trees
                ids = [x for s in range(0, len(raw), step) for x in self.merge_many(raw[s : s + step])]
            first, n = len(self.index), np.array([len(x) for x in ids], np.int64)
            self.index.update(zip((w for w, _ in group), range(first, first + len(ids))))
            total = int(n.sum())
            while self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            while first + len(ids) > len(self.begin):
                self.begin, self.size = np.concatenate([self.begin, self.begin]), np.concatenate([self.size, self.size])
            self.pool[self.used : self.used + total] = np.concatenate(ids)
            self.size[first : first + len(ids)] = n
            self.begin[first : first + len(ids)] = self.used + np.concatenate([[0], np.cumsum(n)[:-1]])
            self.used += total

    def look_up(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts in order, and how many each text has."""
        if len(self.index) > MOST_WORDS:
            self.start()
        found = [self.find(t) if t else [] for t in texts]
        flat = [w for ws in found for w in ws]
        index = self.index
        new = set(flat).difference(index)
        if new:
            self.learn(list(new))
        return np.fromiter(map(index.__getitem__, flat), np.int64, len(flat)), np.array([len(ws) for ws in found], np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the offsets of the texts. Null and empty texts have none."""
        words, per_text = self.look_up(texts)
        n = self.size[words]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.begin[words], n)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return self.pool[at], bounds.astype(np.int32)

    def count(self, texts: list[str | None]) -> np.ndarray:
        words, per_text = self.look_up(texts)
        ends = np.concatenate([[0], np.cumsum(self.size[words])])
        return np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])


_OWN: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """The worker's encoder of a broadcast vocabulary; kept while the worker lives."""
    data = shared.value
    key = hash(data)
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = Encoder(data)
    return _OWN[key]


#: Texts are taken in blocks of so many characters, whole texts always, so that a batch of long ones fits in memory.
BLOCK_CHARS = 8_000_000


def blocks(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    texts = column.to_pylist()
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BLOCK_CHARS:
            yield a, i + 1, texts[a : i + 1]
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts), texts[a:]


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every whole text, without special tokens. Null and empty texts have an empty list.
    Repeated rows come out as often as they stand there; an empty table gives an empty result. No shuffle."""
    kind = documents.schema[id_col].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared)
        for b in batches:
            for start, end, texts in blocks(b.column(1)):
                ids, bounds = e.encode(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))], ["id", "ids"])

    return documents.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(documents: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``; 0 for null and empty texts."""
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = documents.select(*keep, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared)
        for b in batches:
            for start, end, texts in blocks(b.column(len(keep))):
                part = [b.column(i).slice(start, end - start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*part, pa.array(e.count(texts), pa.int64())], [*keep, "n_tokens"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{fields}, n_tokens bigint")
