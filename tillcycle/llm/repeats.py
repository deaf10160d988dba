"""Numpy parts of the suffix-array dedup: anchored runs of windows, and transforms of shards.

Anchors.  Among the ``SEED_LEN``-byte strings of a window the one with the least hash (the
leftmost, of equal ones) is its anchor.  Equal windows have equal anchors at the same place,
so windows can only match where anchors do.  Consecutive windows with one anchor are a run.

Transforms.  A shard is a set of strings.  Its suffixes, sorted, are held as a Burrows-Wheeler
transform in steps of ``STEP`` bytes: for the suffix of rank j its leading block and the rank
of the suffix behind that block (the inverse of the LF mapping).  Two transforms are merged by
refining an interleave: ``lo[i]`` / ``hi[i]``, how many suffixes of the other shard are below /
not above suffix i on their first h bytes, start at 0 / all and advance by one block a round
through the other's transform.  Where lo = hi the common prefix has ended and the suffix drops
out; what stays open after the last round is a repeated interval.  No suffix is sorted again.
"""

from __future__ import annotations

import numpy as np

SEED_LEN, STEP = 128, 16
_MULT = np.random.default_rng(7).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)
_POS_BITS = 22


def seed_hashes(data: np.ndarray, seed_len: int = SEED_LEN) -> np.ndarray:
    """64-bit hash of each ``seed_len``-byte string (a power of two) of ``data``."""
    return folded(_BYTE[data], seed_len)


def folded(h: np.ndarray, seed_len: int) -> np.ndarray:
    """64-bit hash of each ``seed_len`` (a power of two) symbols in a row, by the symbols' own."""
    length, i = 1, 0
    while length < seed_len:
        h = h[:-length] * _MULT[i] + h[length:]
        length, i = 2 * length, i + 1
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def runs(data: np.ndarray, window: int, seed_len: int = SEED_LEN):
    """(first window, last window, anchor, anchor hash) of each run of one string."""
    n = len(data) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return anchored(seed_hashes(data, seed_len), n, window - seed_len + 1)


def anchored(h: np.ndarray, n: int, span: int):
    """The runs of ``n`` windows of ``span`` seeds each, whose hashes are ``h``."""
    cut = np.uint64((1 << _POS_BITS) - 1)
    parts = []
    block = 1 << 16
    for at in range(0, n, block):  # blocks of windows keep the arrays in cache
        k = h[at:min(at + block + span - 1, len(h))]
        m = (k & ~cut) | np.arange(len(k), dtype=np.uint64)
        have = 1
        while 2 * have <= span:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if span > have:
            m = np.minimum(m[:len(m) - (span - have)], m[span - have:])
        parts.append((m & cut).astype(np.int64) + at)
    anchor = np.concatenate(parts)[:n]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return first, last, anchor[first], h[anchor[first]]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def extents(parts: list[bytes]) -> list[int]:
    """For each string, its longest common prefix with any other one."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = common_prefix(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def block_hashes(data: np.ndarray, step: int) -> np.ndarray:
    """64-bit hash of each ``step``-byte string of ``data``."""
    h, length, i = _BYTE[data], 1, 0
    while 2 * length <= step:
        h = h[:-length] * _MULT[i] + h[length:]
        length, i = 2 * length, i + 1
    if step > length:  # two overlapping halves cover the block
        h = h[:len(h) - (step - length)] * _MULT[15] + h[step - length:]
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


class Transform:
    """sym: leading block, by hash; nxt: first rank of the equal suffixes behind it, -1 at the
    end; home: place of the suffix in the batch; first: is it the first of equal suffixes."""

    def __init__(self, sym, nxt, home, first):
        self.sym, self.nxt, self.home, self.first = sym, nxt, home, first

    @classmethod
    def of(cls, strings: list[tuple[int, bytes]], step: int, repeated: np.ndarray) -> Transform:
        """Sorts the suffixes of a shard (place in the batch, string) by doubling, and marks
        the windows of four blocks that it holds twice or more."""
        data = np.frombuffer(b"".join(s for _, s in strings), np.uint8)
        lengths = np.array([len(s) for _, s in strings])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        counts = lengths - step + 1
        owner = np.repeat(np.arange(len(strings)), counts)
        n = int(counts.sum())
        base = np.concatenate([[0], np.cumsum(counts)[:-1]])
        inner = np.arange(n) - base[owner]
        sym = block_hashes(data, step)[starts[owner] + inner]
        home = np.array([h for h, _ in strings])[owner] + inner
        behind = np.where(inner + step < counts[owner], np.arange(n) + step, n)  # n: the end
        rank = np.zeros(n + 1, np.int64)
        rank[:n] = np.unique(sym, return_inverse=True)[1] + 1
        jump, blocks, most = np.append(behind, n), 1, int(-(-lengths.max() // step))
        while blocks < most or blocks < 4:
            both = rank[:n] * (n + 2) + rank[jump[:n]]
            rank[:n] = np.unique(both, return_inverse=True)[1] + 1
            jump, blocks = jump[jump], 2 * blocks
            if blocks == 4:
                whole = np.flatnonzero(inner + 4 * step <= lengths[owner])
                repeated[home[whole[np.bincount(rank[whole])[rank[whole]] > 1]]] = True
        order = np.argsort(rank[:n], kind="stable")
        r = rank[order]
        at = np.zeros(int(r[-1]) + 1, np.int64)
        first = np.concatenate([[True], r[1:] != r[:-1]])
        at[r[first]] = np.flatnonzero(first)
        at[0] = -1
        nxt = at[rank[behind[order]]]
        return cls(sym[order], nxt, home[order], first)

    def merge(self, other: Transform, step: int, window_at: np.ndarray, repeated: np.ndarray) -> Transform:
        """The transform of both; marks the windows that both hold."""
        a, b = self, other
        n, m = len(a.sym), len(b.sym)
        names = np.union1d(a.sym, b.sym)
        a_key = np.searchsorted(names, a.sym) * (m + 2)
        b_keys = np.searchsorted(names, b.sym) * (m + 2) + b.nxt + 1
        lo, hi = np.searchsorted(b_keys, a_key), np.searchsorted(b_keys, a_key + m + 2)
        rounds, open_ = 1, np.flatnonzero(lo < hi)
        while len(open_):
            if rounds == 4:  # the common prefix is a window long
                hit = open_[window_at[a.home[open_]]]
                repeated[a.home[hit]] = True
                span = np.zeros(m + 1, np.int64)
                np.add.at(span, lo[hit], 1)
                np.add.at(span, hi[hit], -1)
                repeated[b.home[np.cumsum(span[:m]) > 0]] = True
            behind = a.nxt[open_]
            ended = behind < 0
            low = np.where(ended, 0, lo[behind] + 1)
            high = np.where(ended, 1, hi[behind] + 1)
            new_lo = np.searchsorted(b_keys, a_key[open_] + low)
            new_hi = np.searchsorted(b_keys, a_key[open_] + high)
            if rounds >= 4 and (new_lo == lo[open_]).all() and (new_hi == hi[open_]).all():
                break
            lo, hi = lo.copy(), hi.copy()
            lo[open_], hi[open_] = new_lo, new_hi
            open_ = open_[new_lo < new_hi]
            rounds += 1
        a_at = np.arange(n) + lo
        b_at = np.arange(m) + np.searchsorted(lo, np.arange(m), "right")
        a_first, b_first = a_at, b_at.copy()
        same = np.flatnonzero(a.first & (lo < hi))
        b_first[lo[same]] = a_at[same]
        b_new = b.first.copy()
        b_new[lo[same]] = False
        sym = np.empty(n + m, np.uint64)
        nxt, home, first = np.empty(n + m, np.int64), np.empty(n + m, np.int64), np.empty(n + m, bool)
        for t, at, to, fresh in ((a, a_at, a_first, a.first), (b, b_at, b_first, b_new)):
            sym[at], home[at], first[at] = t.sym, t.home, fresh
            nxt[at] = np.where(t.nxt < 0, -1, to[t.nxt])
        return Transform(sym, nxt, home, first)


def repeated_windows(strings: list[bytes], window: int, shard_bytes: int) -> list[np.ndarray]:
    """For each string, which of its windows also start anywhere else among the strings."""
    if window % 4:
        raise ValueError("the window must be a multiple of four bytes")
    step = window // 4
    starts = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    repeated = np.zeros(int(starts[-1]) + 1, bool)
    window_at = np.zeros(int(starts[-1]) + 1, bool)
    shards: list[list[tuple[int, bytes]]] = [[]]
    size = 0
    for at, s in zip(starts.tolist(), strings):
        if len(s) < window:
            continue
        window_at[at:at + len(s) - window + 1] = True
        if size and size + len(s) > shard_bytes:
            shards.append([])
            size = 0
        shards[-1].append((at, s))
        size += len(s)
    level = [Transform.of(s, step, repeated) for s in shards if s]
    while len(level) > 1:
        level = [level[i].merge(level[i + 1], step, window_at, repeated) if i + 1 < len(level) else level[i]
                 for i in range(0, len(level), 2)]
    return [repeated[a:a + max(0, len(s) - window + 1)] for a, s in zip(starts.tolist(), strings)]
