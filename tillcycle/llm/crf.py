"""A linear-chain conditional random field over the words of a text, in numpy.

Emissions of a word are the sum of the weights of its features: prefixes and suffixes of one
to three characters, character bigrams and trigrams, and lexicon entries (is it among a
language's frequent words).  Transitions between neighbouring labels are learned with them.
Marginals come from the scaled forward-backward recursion, run for many texts at once.
"""

from __future__ import annotations

import re

import numpy as np

WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters; other word characters that aren't letters don't count."""
    return [w for w in WORDS.findall(text.lower()) if w.isalpha() or any(c.isalpha() for c in w)]


def features(word: str, lexicon: dict[str, list[str]]) -> list[str]:
    edge = f"<{word}>"
    out = [f"p{word[:i]}" for i in (1, 2, 3)] + [f"s{word[-i:]}" for i in (1, 2, 3)]
    out += [edge[i:i + n] for n in (2, 3) for i in range(len(edge) - n + 1)]
    return out + lexicon.get(word, [])


def forward_backward(emit: np.ndarray, active: list[int], step: np.ndarray, start: np.ndarray):
    """B texts side by side, longest first.  emit: (T, B, K) positive scores; active[t]: texts
    with a word t.  Returns scaled alpha and beta, whose product is the marginals', and norms."""
    length, _, _ = emit.shape
    alpha, norm = np.zeros_like(emit), np.ones(emit.shape[:2], emit.dtype)
    for t in range(length):
        n = active[t]
        a = emit[t, :n] * (start if t == 0 else alpha[t - 1, :n] @ step)
        norm[t, :n] = a.sum(axis=1)
        alpha[t, :n] = a / norm[t, :n, None]
    beta = np.ones_like(emit)
    back = step.T
    for t in range(length - 2, -1, -1):
        n = active[t + 1]
        beta[t, :n] = (emit[t + 1, :n] * beta[t + 1, :n] / norm[t + 1, :n, None]) @ back
    return alpha, beta, norm


def stacked(emissions: list[np.ndarray]):
    """Emissions (T_i, K) of texts, longest first, as (T, B, K) with the number active per t."""
    lengths = np.array([len(e) for e in emissions])
    out = np.ones((lengths[0], len(emissions), emissions[0].shape[1]), np.float32)
    for i, e in enumerate(emissions):
        out[:len(e), i] = e
    return out, [int(x) for x in (lengths[None, :] > np.arange(lengths[0])[:, None]).sum(axis=1)]


class Crf:
    """labels, feature index and weights (F + 1, K; the last row is no feature), transitions."""

    def __init__(self, labels, index, weights, step, start, lexicon):
        self.labels, self.index, self.weights = labels, index, weights
        self.step, self.start, self.lexicon = step, start, lexicon

    @classmethod
    def fit(cls, sequences: list[tuple[list[str], list[str]]], rounds: int = 60, rate: float = 0.1,
            l2: float = 1e-4, lexicon_size: int = 500, min_count: int = 2) -> Crf:
        """From (words, labels) sequences by Adam on the mean log-likelihood of a word."""
        labels = sorted({y for _, ys in sequences for y in ys})
        number = {y: i for i, y in enumerate(labels)}
        k = len(labels)
        counts: dict[str, dict[str, int]] = {y: {} for y in labels}
        for ws, ys in sequences:
            for w, y in zip(ws, ys, strict=True):
                counts[y][w] = counts[y].get(w, 0) + 1
        lexicon: dict[str, list[str]] = {}
        for y, c in counts.items():
            for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]:
                lexicon.setdefault(w, []).append(f"={y}")
        types = sorted({w for ws, _ in sequences for w in ws})
        of_type = {w: i for i, w in enumerate(types)}
        feats = [features(w, lexicon) for w in types]
        seen: dict[str, int] = {}
        for fs in feats:
            for f in fs:
                seen[f] = seen.get(f, 0) + 1
        index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= min_count))}
        column = [np.array([index[f] for f in fs if f in index], np.int64) for fs in feats]
        flat = np.concatenate([*column, np.empty(0, np.int64)])
        row = np.repeat(np.arange(len(types)), [len(c) for c in column])
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i][0]))
        words = [np.array([of_type[w] for w in sequences[i][0]]) for i in order]
        truth = [np.array([number[y] for y in sequences[i][1]]) for i in order]
        lengths = np.array([len(w) for w in words])
        active = [int(x) for x in (lengths[None, :] > np.arange(lengths[0])[:, None]).sum(axis=1)]
        there = lengths[None, :] > np.arange(lengths[0])[:, None]
        at_type = np.zeros(there.shape, np.int64)
        at_truth = np.zeros(there.shape, np.int64)
        for i, (w, y) in enumerate(zip(words, truth, strict=True)):
            at_type[:len(w), i], at_truth[:len(w), i] = w, y
        total = int(lengths.sum())
        gold = np.zeros((len(types), k))
        np.add.at(gold, (at_type[there], at_truth[there]), 1.0)
        both = there[1:]
        gold_step = np.zeros((k, k))
        np.add.at(gold_step, (at_truth[:-1][both], at_truth[1:][both]), 1.0)
        gold_start = np.bincount(at_truth[0], minlength=k).astype(float)
        params = [np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

        def by_type(weights):
            return np.stack([np.bincount(row, weights[flat, j], len(types)) for j in range(k)], axis=1)

        for turn in range(1, rounds + 1):
            scores = by_type(params[0])
            emit = np.exp(scores - scores.max(axis=1, keepdims=True))[at_type]
            step, start = np.exp(params[1]), np.exp(params[2])
            alpha, beta, norm = forward_backward(emit, active, step, start)
            gamma = alpha * beta
            gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-30)
            want = np.zeros((len(types), k))
            for j in range(k):
                want[:, j] = np.bincount(at_type[there], gamma[..., j][there], len(types))
            nxt = emit[1:] * beta[1:] / norm[1:, :, None]
            pair = np.einsum("tbi,tbj->ij", alpha[:-1] * both[..., None], nxt) * step
            error = (gold - want)[row]
            grads = [np.stack([np.bincount(flat, error[:, j], len(index)) for j in range(k)], axis=1) / total,
                     (gold_step - pair) / total, (gold_start - gamma[0].sum(axis=0)) / total]
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                g -= l2 * p
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p += rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.999 ** turn)) + 1e-8)
        weights = np.vstack([params[0], np.zeros((1, k))]).astype(np.float32)
        return cls(labels, index, weights, np.exp(params[1]).astype(np.float32),
                   np.exp(params[2]).astype(np.float32), lexicon)

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, K) positive scores, the best label's being 1."""
        none = len(self.index)
        cols = [[self.index.get(f, none) for f in features(w, self.lexicon)] for w in words]
        ends = np.cumsum([len(c) for c in cols])
        sums = np.add.reduceat(self.weights[np.concatenate(cols)], np.concatenate([[0], ends[:-1]]), axis=0)
        return np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -30.0)).astype(np.float32)


class Labeller:
    """A model with the emissions of words met so far; forgets them beyond ``most``."""

    def __init__(self, model: Crf, most: int = 200_000):
        self.model, self.most = model, most
        self.forget()

    def forget(self):
        self.at: dict[str, int] = {}
        self.filled = 0
        self.table = np.empty((1024, len(self.model.labels)), np.float32)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Rows of the table, a word each; words without a letter are left out."""
        parts = [WORDS.findall(t.lower()) for t in texts]
        new = {w for ws in parts for w in ws if w not in self.at}
        if len(self.at) + len(new) > self.most and self.at:
            self.forget()
            new = {w for ws in parts for w in ws}
        letters = [w for w in new if w.isalpha() or any(c.isalpha() for c in w)]
        self.at.update(dict.fromkeys(new, -1))
        if letters:
            base = self.filled
            while base + len(letters) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[base:base + len(letters)] = self.model.emissions(letters)
            self.at.update(zip(letters, range(base, base + len(letters)), strict=True))
            self.filled = base + len(letters)
        out = [np.fromiter(map(self.at.__getitem__, ws), np.int64, len(ws)) for ws in parts]
        return [n[n >= 0] for n in out]

    def marginals(self, texts: list[str], cells: int = 1 << 18):
        """(index, (T, K) marginals) of each text that has a letter; texts of like length are
        processed together, at most ``cells`` words with padding, or one text."""
        numbers = self.numbers(texts)
        order = sorted((i for i in range(len(texts)) if len(numbers[i])), key=lambda i: -len(numbers[i]))
        a = 0
        while a < len(order):
            n = max(1, min(256, cells // len(numbers[order[a]])))
            group = order[a:a + n]
            emit, active = stacked([self.table[numbers[i]] for i in group])
            alpha, beta, _ = forward_backward(emit, active, self.model.step, self.model.start)
            gamma = alpha * beta
            gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-30)
            for j, i in enumerate(group):
                yield i, gamma[:len(numbers[i]), j]
            a += n
