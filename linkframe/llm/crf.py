"""A linear-chain conditional random field over token classes, with skip edges between repeated tokens.

Chains are worked in blocks of padded arrays. Skip edges join tokens of different chains of one document; with them the
graph has loops, and beliefs come from rounds of loopy message passing: forward-backward along every chain that a
message reaches, then new messages across its skip edges, until they settle.
"""

from __future__ import annotations

import numpy as np

#: Places (chains times the longest of them) that are worked at once; a longer chain is worked alone.
BLOCK = 400_000


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def forward_backward(nodes: np.ndarray, length: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (n, T, L), edge sums (L, L) weighted by one a chain, and log partition (n). nodes: (n, T, L) log potentials;
    positions from ``length`` on are padding. Scaled probabilities, so a step is a matrix product."""
    n, most, labels = nodes.shape
    shift = nodes.max(axis=2, keepdims=True)
    emit = np.exp(nodes - shift)
    trans = np.exp(step).astype(nodes.dtype)
    alpha, scale = np.empty_like(emit), np.ones((n, most), emit.dtype)
    alpha[:, 0] = np.exp(start) * emit[:, 0]
    for t in range(most):
        if t:
            alpha[:, t] = (alpha[:, t - 1] @ trans) * emit[:, t]
        s = alpha[:, t].sum(axis=1)
        alpha[:, t] /= s[:, None]
        scale[:, t] = s
    inside = np.arange(most)[None, :] < length[:, None]
    beta = np.ones_like(emit)
    for t in range(most - 2, -1, -1):
        b = (emit[:, t + 1] * beta[:, t + 1]) @ trans.T / scale[:, t + 1][:, None]
        beta[:, t] = np.where(inside[:, t + 1][:, None], b, 1.0)
    belief = alpha * beta
    belief /= belief.sum(axis=2, keepdims=True)
    log_z = ((np.log(scale) + shift[:, :, 0]) * inside).sum(axis=1)
    return belief, (alpha, beta, emit, trans, scale, inside), log_z


def largest(a: np.ndarray) -> np.ndarray:
    """Largest of the last axis, which is kept; halves against each other, as numpy is slow along a short axis."""
    while (n := a.shape[-1]) > 1:
        half = n // 2
        a = np.maximum(a[..., :half], a[..., half : 2 * half]) if n % 2 == 0 else np.concatenate([np.maximum(a[..., :half], a[..., half : 2 * half]), a[..., -1:]], axis=-1)
    return a


def total(a: np.ndarray) -> np.ndarray:
    """Sum of the last axis, which is kept."""
    return np.einsum("...j->...", a)[..., None]


def marginals(nodes: np.ndarray, length: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Marginals alone, of chains by rising length; nodes and result: (T, n, L). Of every step only chains that reach it are worked."""
    most, n, labels = nodes.shape
    emit = np.exp(nodes - largest(nodes))
    trans, ones = np.exp(step).astype(nodes.dtype), np.ones((labels, 1), nodes.dtype)
    from_ = np.searchsorted(length, np.arange(most), side="right")  # the first chain that has a place t
    belief = np.empty_like(emit)
    a = np.exp(start).astype(nodes.dtype) * emit[0]
    a /= a @ ones
    belief[0] = a
    for t in range(1, most):
        k = from_[t]
        a = (belief[t - 1, k:] @ trans) * emit[t, k:]
        a /= a @ ones
        belief[t, k:] = a
    back, b = np.ascontiguousarray(trans.T), np.ones((n, labels), nodes.dtype)
    for t in range(most - 2, -1, -1):
        k = from_[t + 1]
        c = (emit[t + 1, k:] * b[k:]) @ back
        c /= c @ ones
        b[k:] = c
        c = belief[t, k:] * c
        c /= c @ ones
        belief[t, k:] = c
    return belief


def edge_sums(parts, weight: np.ndarray) -> np.ndarray:
    alpha, beta, emit, trans, scale, inside = parts
    w = np.where(inside[:, 1:], weight[:, None] / scale[:, 1:], 0.0)
    return np.einsum("nti,ntj->ij", alpha[:, :-1] * w[:, :, None], emit[:, 1:] * beta[:, 1:], optimize=True) * trans


class Crf:
    """Weights of features (integers) and label pairs. Unknown features weigh nothing."""

    def __init__(self, labels: list[str], templates):
        self.labels, self.templates = labels, templates
        self.index: dict = {}
        self.weights = np.zeros((1, len(labels)))
        self.start = np.zeros(len(labels))
        self.step = np.zeros((len(labels), len(labels)))

    def features(self, classes: tuple, grow: bool = False) -> np.ndarray:
        rows = []
        for feats in self.templates(classes):
            if grow:
                rows.append([self.index.setdefault(f, len(self.index) + 1) for f in feats])
            else:
                rows.append([self.index.get(f, 0) for f in feats])
        return np.array(rows, np.int64)

    def nodes(self, classes: tuple) -> np.ndarray:
        return self.weights[self.features(classes)].sum(axis=1)

    def train(self, data: dict[tuple, float], rounds: int = 60, rate: float = 0.25, decay: float = 2e-4) -> None:
        """data: (classes, labels as numbers) -> weight. Batch gradient of the log likelihood, with adaptive steps (Adam)."""
        items = sorted(data.items(), key=lambda x: (len(x[0][0]), x[0]))
        feats = [self.features(c, True) for (c, _), _ in items]
        width = len(self.labels)
        self.weights = np.zeros((len(self.index) + 1, width))
        total = sum(w for _, w in items)
        blocks = []
        for a in range(0, len(items), 256):
            part = items[a : a + 256]
            length = np.array([len(c) for (c, _), _ in part])
            most, k = int(length.max()), feats[a].shape[1]
            f = np.zeros((len(part), most, k), np.int64)
            y = np.zeros((len(part), most), np.int64)
            for i, ((_, labels), _) in enumerate(part):
                f[i, : length[i]] = feats[a + i]
                y[i, : length[i]] = labels
            ids, at = np.unique(f, return_inverse=True)  # the features of a block are few of all
            blocks.append((f, y, length, np.array([w for _, w in part]), ids, at.ravel()))
        params = [self.weights, self.start, self.step]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        eye = np.eye(width)
        for r in range(1, rounds + 1):
            g = [-decay * total * p for p in params]
            for f, y, length, w, ids, at in blocks:
                nodes = self.weights[f].sum(axis=2)
                belief, parts, _ = forward_backward(nodes, length, self.start, self.step)
                inside = np.arange(f.shape[1])[None, :] < length[:, None]
                diff = (eye[y] - belief) * (inside * w[:, None])[:, :, None]
                flat = np.repeat(diff.reshape(-1, width), f.shape[2], axis=0)
                g[0][ids] += np.stack([np.bincount(at, flat[:, j], len(ids)) for j in range(width)], axis=1)
                g[1] += diff[:, 0].sum(axis=0)
                pair = inside[:, 1:] * w[:, None]
                np.add.at(g[2], (y[:, :-1].ravel(), y[:, 1:].ravel()), pair.ravel())
                g[2] -= edge_sums(parts, w)
            g[0][0] = 0
            for p, d, a, b in zip(params, g, m, v):
                d = d / total
                a *= 0.9
                a += 0.1 * d
                b *= 0.98
                b += 0.02 * d * d
                p += rate * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.98**r)) + 1e-4)
        self.weights[0] = 0

    def beliefs(self, nodes: list[np.ndarray]) -> list[np.ndarray]:
        """Marginals of chains without skip edges."""
        if not nodes:
            return []
        size = np.array([len(x) for x in nodes])
        offset = np.concatenate([[0], np.cumsum(size)])
        out = self.beliefs_at(np.concatenate(nodes), offset, size, np.arange(len(nodes)))
        return [out[s:e] for s, e in zip(offset, offset[1:])]

    def beliefs_at(self, base: np.ndarray, offset: np.ndarray, size: np.ndarray, which: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Marginals of the chains ``which`` of chains that stand one after another in ``base``, written to their places of ``out``."""
        if out is None:
            out = np.zeros(base.shape, np.float32)
        order = which[np.argsort(size[which], kind="stable")]
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * size[order[b]] <= BLOCK:
                b += 1
            part, a = order[a:b], b
            length = size[part]
            places = np.arange(length[-1])[:, None]
            inside = places < length
            at = np.where(inside, offset[part] + places, 0)
            x = base[at].astype(np.float32)  # its probabilities are scaled at every step
            out[at[inside]] = marginals(x, length, self.start, self.step)[inside]
        return out

    def loopy(self, nodes: list[np.ndarray], first: list[np.ndarray], edges: np.ndarray, same: np.ndarray, rounds: int = 200, damp: float = 0.5, settled: float = 1e-3) -> list[np.ndarray]:
        """Beliefs of chains joined by skip edges. edges: rows (chain, place, chain, place); same (L, L): log potential of a
        skip edge. ``first``: beliefs without them. Damped, all edges at once, until what the messages tell a place moves nowhere by more than ``settled``
        (or for so many rounds, where the messages swing)."""
        labels = len(self.labels)
        psi = np.exp(same)
        size = np.array([len(x) for x in nodes])
        offset = np.concatenate([[0], np.cumsum(size)])
        a, b = offset[edges[:, 0]] + edges[:, 1], offset[edges[:, 2]] + edges[:, 3]
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        message = np.full((len(src), labels), 1.0 / labels)
        # Only places of edges are told anything; the messages to one of them stand together.
        order = np.argsort(dst, kind="stable")
        places, begin = np.unique(dst[order], return_index=True)
        chain_of = np.searchsorted(offset, places, side="right") - 1
        nodes = np.concatenate(nodes)
        base, own = nodes.copy(), nodes[places]
        belief, used = np.concatenate(first), np.ones_like(own)
        for _ in range(rounds):
            out = belief[src] / np.maximum(message[back], 1e-12)
            out /= total(out)
            new = np.einsum("ij,jk->ik", out, psi)  # no BLAS: its threads spin on after such a small product
            new /= total(new)
            message = damp * message + (1 - damp) * new
            extra = np.add.reduceat(np.log(message)[order], begin)
            # Chains whose messages stay as they were keep their beliefs.
            told = np.exp(extra - largest(extra))  # of many messages a sum, so compared as what it tells
            moved = np.unique(chain_of[largest(np.abs(told - used))[:, 0] > settled])
            if not len(moved):
                break
            base[places] = own + extra
            alone = offset[moved[size[moved] == 1]]  # the nodes of all mentions: their beliefs need no pass along a chain
            b = base[alone] + self.start
            b = np.exp(b - b.max(axis=1, keepdims=True))
            belief[alone] = b / b.sum(axis=1, keepdims=True)
            self.beliefs_at(base, offset, size, moved[size[moved] > 1], belief)
            now = np.isin(chain_of, moved)
            used[now] = told[now]
        return [belief[s:e] for s, e in zip(offset, offset[1:])]
