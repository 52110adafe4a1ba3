"""Content-hash identity: Murmur3 x64 128, worked over whole batches with numpy, and the ids made of it."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkframe.functions.iri import resolve
from linkframe.schema import TYPE

# Constants of the hash.
C1, C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)
N1, N2 = np.uint64(0x52DCE729), np.uint64(0x38495AB5)
F1, F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _final(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * F1
    x = x ^ (x >> np.uint64(33))
    x = x * F2
    return x ^ (x >> np.uint64(33))


def murmur3(texts: Iterable[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The two 64-bit halves of every text's hash. Texts are worked in blocks of the same number of 16-byte words."""
    raw = list(texts)
    lo, hi = np.zeros(len(raw), np.uint64), np.zeros(len(raw), np.uint64)
    size = np.array([len(b) for b in raw], np.int64)
    for words in np.unique(size // 16):
        at = np.flatnonzero(size // 16 == words)
        width = int(words) * 16 + 16
        flat = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in at), "<u8").reshape(len(at), -1)
        h1, h2 = np.full(len(at), seed, np.uint64), np.full(len(at), seed, np.uint64)
        for w in range(int(words)):
            h1 ^= _rot(flat[:, 2 * w] * C1, 31) * C2
            h1 = (_rot(h1, 27) + h2) * np.uint64(5) + N1
            h2 ^= _rot(flat[:, 2 * w + 1] * C2, 33) * C1
            h2 = (_rot(h2, 31) + h1) * np.uint64(5) + N2
        # The tail is padded with zeros, whose products are zero and change nothing.
        h2 ^= _rot(flat[:, -1] * C2, 33) * C1
        h1 ^= _rot(flat[:, -2] * C1, 31) * C2
        n = size[at].astype(np.uint64)
        h1, h2 = h1 ^ n, h2 ^ n
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _final(h1), _final(h2)
        h1 = h1 + h2
        lo[at], hi[at] = h1, h2 + h1
    return lo, hi


def ids_of(texts: Iterable[str], bits: int = 64) -> list[str]:
    """Short ids: the upper ``bits`` of the first half, big-endian, in URL-safe base 64 without padding."""
    h, _ = murmur3(t.encode("utf-8") for t in texts)
    packed = (h.view(np.int64) >> np.int64(64 - bits)).astype(">i8").tobytes()
    return [base64.urlsafe_b64encode(packed[i : i + 8]).rstrip(b"=").decode() for i in range(0, len(packed), 8)]


def id_of(text: str, bits: int = 64) -> str:
    return ids_of([text], bits)[0]


class IdGen:
    """Ids of texts, or of a running counter, resolved against a base. ``next`` hashes 0, 1, ... (with ``salt`` after it)."""

    def __init__(self, base: str | None = None, salt: str = "", bits: int = 64):
        self.base, self.salt, self.bits, self.count = base, salt, bits, 0

    def send(self, text: str | None) -> str:
        if text is None:
            return next(self)
        rid = id_of(text, self.bits)
        return resolve(rid, self.base) if self.base else rid

    def __next__(self) -> str:
        out = self.send(f"{self.count}{self.salt}")
        self.count += 1
        return out


def fingerprint_text(pairs: Iterable[tuple[str, str]], etype: str | None) -> str:
    """The plain text that is hashed: type and pairs, sorted, as compact JSON with escapes."""
    full = {(k, v) for k, v in pairs} | ({(TYPE, etype)} if etype is not None else set())
    return json.dumps(sorted(full), separators=(",", ":"))


def resource_id(pairs: Iterable[tuple[str, str]], etype: str | None, base: str | None = None) -> str:
    rid = id_of(fingerprint_text(pairs, etype))
    return resolve(rid, base) if base else rid


def hash_id(text: Column) -> Column:
    """Id of a text column; null stays null."""

    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), dtype=object)
        given = s.notna()
        if given.any():
            out[given.to_numpy()] = ids_of(s[given])
        return out

    return F.pandas_udf(run, "string")(text)


def entity_id(etype: Column, keys: Column, values: Column, base: str | None = None) -> Column:
    """``resource_id`` of a type and two parallel arrays of keys and values."""

    def run(t: pd.Series, k: pd.Series, v: pd.Series) -> pd.Series:
        texts = [fingerprint_text(zip(ks if ks is not None else [], vs if vs is not None else []), x) for x, ks, vs in zip(t, k, v)]
        ids = ids_of(texts)
        return pd.Series([resolve(i, base) for i in ids] if base else ids, dtype=object)

    return F.pandas_udf(run, "string")(etype, keys, values)
