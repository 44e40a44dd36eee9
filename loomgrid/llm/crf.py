"""A linear-chain conditional random field over words, in numpy: features, inference by forward-backward, training.

A word's score for a label is the sum of learned weights of its features: the word itself if the learned lexicon holds it, its
opening and ending of three letters, and the 2- and 3-grams of the word between marks of its start and end, hashed into a fixed table. Neighbouring labels
score by learned transitions. All sequences of a batch are worked on side by side: each is cut into chunks, a chunk's
messages are composed into one small matrix, chunks are chained by these, and then every chunk is swept at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

#: Rows of the hashed weight table, and words of a chunk.
BUCKETS, CHUNK = 1 << 15, 32


_SALTS = {2: 0x9E3779B97F4A7C15, 3: 0xC2B2AE3D27D4EB4F, "^": 0x165667B19E3779F9, "$": 0x27D4EB2F165667C5}


def _hashed(codes: list[np.ndarray], kind: int | str) -> np.ndarray:
    """Rows of the weight table for letter sequences given letter by letter."""
    mixed = np.full(len(codes[0]), _SALTS[kind], np.uint64)
    for letters in codes:
        mixed = (mixed ^ letters) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(33)
    return (mixed % np.uint64(BUCKETS)).astype(np.int64)


def feature_rows(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the weight table of all words one after another, how many each word has); every word has some."""
    marked = "".join([f"^{w}$" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    stops = np.cumsum(sizes)
    starts = stops - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    rows, of = [], []
    for n in (2, 3):
        windows = [codes[i : len(codes) - n + 1 + i] for i in range(n)]
        inside = owner[: len(codes) - n + 1] == owner[n - 1 :]
        rows.append(_hashed([w[inside] for w in windows], n))
        of.append(owner[: len(codes) - n + 1][inside])
    long = np.flatnonzero(sizes >= 5)
    for kind, at in (("^", starts[long] + 1), ("$", stops[long] - 4)):
        rows.append(_hashed([codes[at + i] for i in range(3)], kind))
        of.append(long)
    held = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if held:
        of.append(np.array([i for i, _ in held]))
        rows.append(BUCKETS + np.array([r for _, r in held]))
    of, rows = np.concatenate(of), np.concatenate(rows)
    return rows[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


class Model(NamedTuple):
    """labels; lexicon word -> number; weights (BUCKETS + lexicon, labels); transitions (labels, labels), from row to column."""

    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray


class Emissions:
    """Scores of words, computed once and kept up to a limit of words, and of numbers in the table."""

    LIMIT, LIMIT_CELLS = 120_000, 8_000_000

    def __init__(self, model: Model) -> None:
        self.model = model
        self.limit = min(self.LIMIT, self.LIMIT_CELLS // max(1, len(model.labels)))
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.labels)), np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > self.limit:
            self.rows.clear()
        rows = self.rows
        new = list(set(words).difference(rows))
        if new:
            start = len(rows)
            rows.update(zip(new, range(start, start + len(new)), strict=True))
            while len(rows) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            flat, sizes = feature_rows(new, self.model.lexicon)
            self.table[start : start + len(new)] = np.add.reduceat(self.model.weights[flat], np.cumsum(sizes) - sizes, axis=0)
        return self.table[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of every word; sequences lie one after another in `emissions`, `lengths` gives their words (>= 1)."""
    n, k = emissions.shape
    psi = np.exp(emissions - emissions.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    step = np.exp(transitions - transitions.max())
    chunks_of = -(-lengths // CHUNK)
    chunks = int(chunks_of.sum())
    first = np.cumsum(chunks_of) - chunks_of  # each sequence's first chunk
    start = np.cumsum(lengths) - lengths
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) - start[sequence]
    chunk, slot = first[sequence] + place // CHUNK, place % CHUNK
    grid = np.ones((CHUNK, chunks, k))
    grid[slot, chunk] = psi
    filled = np.zeros((CHUNK, chunks), bool)
    filled[slot, chunk] = True
    # Message composed over each chunk: row i is what a unit message at label i before the chunk becomes after it.
    compose = np.broadcast_to(np.eye(k), (chunks, k, k)).copy()
    for t in range(CHUNK):
        on = filled[t]
        if not on.any():
            break
        moved = (compose[on].reshape(-1, k) @ step).reshape(-1, k, k) * grid[t, on][:, None, :]
        compose[on] = moved / moved.sum(axis=(1, 2), keepdims=True)
    before, after = np.ones((chunks, k)), np.ones((chunks, k))
    longest = int(chunks_of.max())
    order = np.argsort(-chunks_of, kind="stable")
    alive = np.searchsorted(-chunks_of[order], -np.arange(1, longest + 1), side="right")  # sequences with more than j chunks
    for j in range(1, longest):
        at = first[order[: alive[j]]] + j
        message = (before[at - 1, :, None] * compose[at - 1]).sum(axis=1)
        before[at] = message / message.sum(axis=1, keepdims=True)
    for j in range(longest - 1, 0, -1):
        at = first[order[: alive[j]]] + j
        message = (compose[at] * after[at, None, :]).sum(axis=2)
        after[at - 1] = message / message.sum(axis=1, keepdims=True)
    ahead, behind = np.empty((CHUNK, chunks, k)), np.empty((CHUNK, chunks, k))
    message = before
    for t in range(CHUNK):
        moved = (message @ step) * grid[t]
        message = np.where(filled[t][:, None], moved / moved.sum(axis=1, keepdims=True), message)
        ahead[t] = message
    message = after
    for t in range(CHUNK - 1, -1, -1):
        behind[t] = message
        moved = (message * grid[t]) @ step.T
        message = np.where(filled[t][:, None], moved / moved.sum(axis=1, keepdims=True), message)
    both = ahead[slot, chunk] * behind[slot, chunk]
    return both / both.sum(axis=1, keepdims=True)


def marginals_of_long(scores: Callable[[int, int], np.ndarray], words: int, transitions: np.ndarray, block: int) -> Iterator[tuple[int, np.ndarray]]:
    """As `marginals` for one sequence of any length: (first word, probabilities) block by block, the last block first.

    `scores(a, b)` gives the emissions of words a to b - 1. A forward pass keeps the message that enters each block; the backward pass works
    every block out again from there. So memory goes by the block and the number of blocks, and the work by words times labels squared.
    """
    k = len(transitions)
    step = np.exp(transitions - transitions.max())

    def forward(a: int, message: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        given = scores(a, min(words, a + block))
        psi = np.exp(given - given.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
        ahead = np.empty_like(psi)
        for t in range(len(psi)):
            message = (message @ step) * psi[t]
            message = message / message.sum()
            ahead[t] = message
        return psi, ahead

    entering = [np.ones(k)]
    for a in range(0, words - block, block):
        entering.append(forward(a, entering[-1])[1][-1].copy())  # a view would hold the whole block
    message, back = np.ones(k), step.T.copy()
    for b in range(len(entering) - 1, -1, -1):
        psi, both = forward(b * block, entering[b])
        for t in range(len(psi) - 1, -1, -1):
            both[t] *= message
            message = (message * psi[t]) @ back
            message = message / message.sum()
        yield b * block, both / both.sum(axis=1, keepdims=True)


def _train_pass(psi: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word marginals (B, T, K), summed pair marginals (K, K)) for sequences of one length."""
    b, t, k = psi.shape
    ahead, behind = np.empty_like(psi), np.ones_like(psi)
    message = np.ones((b, k))
    for i in range(t):
        message = (message @ step) * psi[:, i]
        message = message / message.sum(axis=1, keepdims=True)
        ahead[:, i] = message
    for i in range(t - 2, -1, -1):
        message = (behind[:, i + 1] * psi[:, i + 1]) @ step.T
        behind[:, i] = message / message.sum(axis=1, keepdims=True)
    single = ahead * behind
    single /= single.sum(axis=2, keepdims=True)
    pair = ahead[:, :-1, :, None] * step * (psi[:, 1:] * behind[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return single, pair.sum(axis=(0, 1))


def train(sequences: list[tuple[list[str], list[int]]], labels: list[str], lexicon_size: int = 3000, epochs: int = 6, rate: float = 0.25, ridge: float = 1e-5, batch: int = 256) -> Model:
    """A model fitted by AdaGrad to the likelihood of labelled word sequences of one common length."""
    times: dict[str, int] = {}
    for words, _ in sequences:
        for w in words:
            times[w] = times.get(w, 0) + 1
    often = sorted((w for w, c in times.items() if c >= 5), key=lambda w: (-times[w], w))[:lexicon_size]
    lexicon = {w: i for i, w in enumerate(often)}
    k = len(labels)
    weights, moved = np.zeros((BUCKETS + len(lexicon), k)), np.full((BUCKETS + len(lexicon), k), 1e-8)
    transitions, stirred = np.zeros((k, k)), np.full((k, k), 1e-8)
    vocabulary = sorted(times)
    number = {w: i for i, w in enumerate(vocabulary)}
    every, many = feature_rows(vocabulary, lexicon) if vocabulary else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    begin = np.cumsum(many) - many
    rng = np.random.default_rng(7)
    for _ in range(epochs if sequences else 0):
        order = rng.permutation(len(sequences))
        for part in range(0, len(order), batch):
            some = [sequences[i] for i in order[part : part + batch]]
            used = np.array([number[w] for words, _ in some for w in words])
            sizes = many[used]
            flat = every[np.repeat(begin[used] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
            scores = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0).reshape(len(some), -1, k)
            truth = np.array([y for _, y in some])
            psi = np.exp(scores - scores.max(axis=2, keepdims=True)) + 1e-30
            single, pair = _train_pass(psi, np.exp(transitions - transitions.max()))
            error = single
            error[np.arange(len(some))[:, None], np.arange(truth.shape[1])[None], truth] -= 1
            word_of = np.repeat(np.arange(len(sizes)), sizes)
            flat_error = error.reshape(-1, k)[word_of]
            touched, at = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(at, flat_error[:, j], len(touched)) for j in range(k)], axis=1) / len(some) + ridge * weights[touched]
            moved[touched] += grad**2
            weights[touched] -= rate * grad / np.sqrt(moved[touched])
            seen = np.bincount((truth[:, :-1] * k + truth[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
            grad = (pair - seen) / len(some) + ridge * transitions
            stirred += grad**2
            transitions -= rate * grad / np.sqrt(stirred)
    return Model(labels, lexicon, weights.astype(np.float32), transitions)
