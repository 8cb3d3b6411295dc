"""Linear-chain conditional random fields on hashed features, in NumPy.

A chain's score is the sum of its tokens' emissions (rows of a hashed weight table) and of its learned
transitions. Training maximises the likelihood by AdaGrad over batches of equally long chains;
marginals of long chains are exact and run over pieces of a chain side by side.
"""

from __future__ import annotations

import zlib

import numpy as np

CHUNK = 256


def hashed(names: list[str], buckets: int) -> list[int]:
    return [zlib.crc32(x.encode()) & (buckets - 1) for x in names]


def emissions(weights: np.ndarray, feats: list[list[int]]) -> np.ndarray:
    """Sum of weight rows for each token."""
    if not feats:
        return np.zeros((0, weights.shape[1]))
    sizes = np.fromiter(map(len, feats), np.int64, len(feats))
    flat = np.fromiter((x for f in feats for x in f), np.int64, int(sizes.sum()))
    return np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0)


def forward_backward(emit: np.ndarray, trans: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Posterior of each label at each token, for chains of ``lens`` tokens one after another.

    Chains are cut into pieces of ``CHUNK`` tokens. The pieces' transfer matrices carry the messages over
    piece borders, so the result is that of one pass over each chain.
    """
    k = trans.shape[0]
    out = np.ones((len(emit), k)) / k
    lens = np.asarray(lens, np.int64)
    first = np.cumsum(lens) - lens
    n_pieces = -(-lens // CHUNK)
    if not n_pieces.sum():
        return out[:0]
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    a = np.exp(trans - trans.max())
    chain = np.repeat(np.arange(len(lens)), n_pieces)
    piece = np.arange(len(chain)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    start = first[chain] + piece * CHUNK
    size = np.minimum(CHUNK, lens[chain] - piece * CHUNK)

    head = np.full((len(chain), k), 1 / k)
    tail = np.ones((len(chain), k))
    inner = np.flatnonzero(n_pieces[chain] > 1)
    if len(inner):
        order = inner[np.argsort(-size[inner], kind="stable")]
        m = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
        live = np.searchsorted(-size[order], -np.arange(CHUNK), side="left")
        for t in range(int(size[order[0]])):
            n = live[t]
            step = np.broadcast_to(a, (n, k, k))
            if t == 0:  # nothing stands before a chain's first token
                step = np.where((piece[order[:n]] == 0)[:, None, None], np.eye(k), step)
            x = (m[:n] @ step) * e[start[order[:n]] + t][:, None, :]
            m[:n] = x / x.sum(axis=(1, 2), keepdims=True)
        whole = np.zeros((len(chain), k, k))
        whole[order] = m
        for p in range(1, int(n_pieces.max())):
            at = np.flatnonzero(piece == p)
            x = np.einsum("ni,nij->nj", head[at - 1], whole[at - 1])
            head[at] = x / x.sum(axis=1, keepdims=True)
        for p in range(int(n_pieces.max()) - 2, -1, -1):
            at = np.flatnonzero((piece == p) & (n_pieces[chain] > p + 1))
            x = np.einsum("nij,nj->ni", whole[at + 1], tail[at + 1])
            tail[at] = x / x.sum(axis=1, keepdims=True)

    order = np.argsort(-size, kind="stable")
    start, size, head, tail, opens = start[order], size[order], head[order], tail[order], (piece[order] == 0)[:, None]
    steps = int(size[0])
    live = np.searchsorted(-size, -np.arange(steps), side="left")
    x = head.copy()
    for t in range(steps):
        n = live[t]
        y = (x[:n] @ a if t else np.where(opens, x, x @ a)) * e[start[:n] + t]
        x[:n] = y / y.sum(axis=1, keepdims=True)
        out[start[:n] + t] = x[:n]
    x = tail.copy()
    for t in range(steps - 1, -1, -1):
        n = live[t]
        at = start[:n] + t
        out[at] *= x[:n]
        y = (x[:n] * e[at]) @ a.T
        x[:n] = y / y.sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True)


def viterbi(emit: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best labels of one chain; ``first`` and ``last`` are scores for its ends."""
    n, k = emit.shape
    back = np.zeros((n, k), np.int64)
    x = emit[0] + first
    for t in range(1, n):
        s = x[:, None] + trans
        back[t] = s.argmax(axis=0)
        x = s.max(axis=0) + emit[t]
    out = np.empty(n, np.int64)
    out[-1] = int((x + last).argmax())
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def train(
    feats: list[list[list[int]]], tags: list[list[int]], k: int, buckets: int, epochs: int = 6, batch: int = 64, rate: float = 0.2, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """Weights ``(buckets, k)`` and transitions ``(k, k)`` from tagged chains."""
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros((buckets, k)), np.full((buckets, k), 1e-6)
    a, ga2 = np.zeros((k, k)), np.full((k, k), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(feats))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            tokens = [f for c in part for f in feats[c]]
            lens = np.array([len(feats[c]) for c in part])
            gold = np.array([t for c in part for t in tags[c]])
            if not len(gold):
                continue
            emit = emissions(w, tokens)
            post = forward_backward(emit, a, lens)
            delta = post.copy()
            delta[np.arange(len(gold)), gold] -= 1
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            flat = np.fromiter((x for f in tokens for x in f), np.int64, int(sizes.sum()))
            used, place = np.unique(flat, return_inverse=True)
            rep = np.repeat(delta, sizes, axis=0)
            g = np.stack([np.bincount(place, rep[:, j], len(used)) for j in range(k)], axis=1) / len(part)
            g2[used] += g * g
            w[used] -= rate * g / np.sqrt(g2[used])
            ends = np.cumsum(lens) - 1
            inside = np.ones(len(gold), bool)
            inside[ends] = False
            at = np.flatnonzero(inside)
            if len(at):
                pair = _pairs(emit, a, lens)[at]
                want = np.zeros((k, k))
                np.add.at(want, (gold[at], gold[at + 1]), 1)
                ga = (pair.sum(axis=0) - want) / len(part)
                ga2 += ga * ga
                a -= rate * ga / np.sqrt(ga2)
    return w, a


def _pairs(emit: np.ndarray, trans: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Posterior of each pair of labels at tokens t and t+1 (rows at chain ends are meaningless)."""
    n, k = emit.shape
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    a = np.exp(trans - trans.max())
    fwd, bwd = np.empty((n, k)), np.empty((n, k))
    order = np.argsort(-lens, kind="stable")
    size, start = lens[order], (np.cumsum(lens) - lens)[order]
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    x = np.full((len(size), k), 1 / k)
    for t in range(int(size[0])):
        m = live[t]
        y = (x[:m] @ a if t else x) * e[start[:m] + t]
        fwd[start[:m] + t] = x[:m] = y / y.sum(axis=1, keepdims=True)
    x = np.ones((len(size), k))
    for t in range(int(size[0]) - 1, -1, -1):
        m = live[t]
        bwd[start[:m] + t] = x[:m]
        y = (x[:m] * e[start[:m] + t]) @ a.T
        x[:m] = y / y.sum(axis=1, keepdims=True)
    nxt = np.roll(e * bwd, -1, axis=0)
    p = fwd[:, :, None] * a[None] * nxt[:, None, :]
    return p / np.maximum(p.sum(axis=(1, 2), keepdims=True), 1e-300)
