"""Packing documents into fixed windows by non-negative least squares.

1. Each document is tokenised whole; its full windows are sequences of their own and its
   remainder is one piece.  The table written holds lengths, checksums and remainder ids.
2. The histogram of remainder lengths (at most ``window`` - 1 rows, whatever the input) goes
   to the driver.  Patterns are combinations of up to ``depth`` = 3 lengths that fill a window;
   ``min ||A x - histogram||, x >= 0`` gives how often each is used.  Patterns are added while
   they reduce the residual, repeat counts are rounded to what the histogram holds.
3. What is left is packed greedily: first whole pieces that fill a window exactly, longest
   first; the rest end to end, cut at window ends.  So only the last sequence has padding.
4. A piece's place follows from its rank among the pieces of its length.  Ranks are counted
   per (length, bucket) and sorted within one bucket only.

Defined cases: a null text is an empty one, of the end id alone; repeated rows are documents
of their own (rows equal in all the order's columns are interchangeable); an empty table
gives no piece.  Columns but doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillcycle.llm.common import written

WINDOW, END_ID = 1024, 0
#: Rows that a worker holds as Python objects at once.
ROWS = 512
#: Beyond Latin letters the libraries' Unicode tables may differ: such texts go the plain way.
_OTHER_SCRIPTS = re.compile(r"[^\x00-\u024f\u2010-\u2027]")
#: The byte-level pre-tokenizer's pattern, without needless backtracking.
_PIECE = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s")
_encoders: dict[str, Encoder] = {}


def _byte_of_char() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 ones are
    themselves, the others count up from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by the tokenizer file at ``path``.

    Where the file is a byte-level BPE whose merges are in the order of their ids, its ranks
    are read into a faster encoder with the same ids; texts with special tokens or other
    scripts, and all other files, go through the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.fast = self._ranked(spec)
        vocab = spec["model"].get("vocab")
        size = len(set(vocab).union(self.special)) if isinstance(vocab, dict) else self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    @cached_property
    def tokenizer(self):
        """Read when a text first needs it: a worker that keeps both takes about twice the memory."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def _ranked(self, spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel"
                 and before.get("use_regex", True) and not before.get("add_prefix_space", True)
                 and not model.get("dropout") and not model.get("ignore_merges")
                 and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
        if not plain:
            return None
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocab["".join(m)] for m in pairs]
        if any(x >= y for x, y in zip(ids, ids[1:])):
            return None
        import tiktoken
        of = _byte_of_char()
        ranks = {bytes(of[c] for c in word): i for word, i in vocab.items() if word not in self.special}
        return tiktoken.Encoding("ranks", pat_str=_PIECE, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not _OTHER_SCRIPTS.search(text) and not any(x in text for x in self.special):
            return np.array(self.fast.encode_ordinary(text), self.dtype)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_MEASURED = "doc_id long, tokens long, crcs array<long>, rem int, rem_crc long, rem_ids binary"


def measured(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Per row: number of ids, checksums of full windows, and the remainder."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in _few(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = np.append(encode(text or ""), np.array(end_id, encode.dtype))
                full = len(ids) // window
                rest = ids[full * window:]
                rows.append((len(ids), [_crc(ids[i * window:(i + 1) * window]) for i in range(full)],
                             len(rest), _crc(rest), rest.tobytes()))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols],
                                                 names=["doc_id", "tokens", "crcs", "rem", "rem_crc", "rem_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, _MEASURED)


def nnls(cols: np.ndarray, h: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """min ||A x - h||, x >= 0, from ``x`` by accelerated projected gradient.  A's columns are
    the rows of ``cols``: lengths, 0 for none."""
    def times(v):
        out = np.zeros(len(h))
        for j in range(cols.shape[1]):
            np.add.at(out, cols[:, j], v)
        out[0] = 0.0
        return out

    def turned(r):
        return sum(np.where(cols[:, j] > 0, r[cols[:, j]], 0.0) for j in range(cols.shape[1]))

    v = np.ones(len(cols))
    for _ in range(20):
        v = turned(times(v))
        v /= max(np.linalg.norm(v), 1e-12)
    lipschitz = max(float(v @ turned(times(v))) * 1.05, 1e-9)
    y, t = x.copy(), 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - turned(times(y) - h) / lipschitz)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, rounds: int = 12, add: int = 400) -> dict:
    """Where the pieces of each length go, by rank: {length: [(first rank, sequence, offset)]},
    the sequences' number, and for the pieces packed end to end {length: (first rank, begin)}."""
    h = np.zeros(window, np.int64)
    for length, n in histogram.items():
        h[length] = n
    there = h > 0
    grid_a, grid_b = np.triu_indices(window)
    grid_c = window - grid_a - grid_b
    ok = (grid_a >= 1) & (grid_c >= grid_b)
    grid = np.stack([grid_a[ok], grid_b[ok], grid_c[ok]], axis=1)
    half = np.arange(1, window // 2 + 1)
    grid = np.concatenate([np.stack([half, window - half, np.zeros_like(half)], axis=1), grid])
    grid = grid[(there[grid] | (grid == 0)).all(axis=1)]
    chosen = np.zeros(len(grid), bool)
    x = np.zeros(len(grid))
    rest = h.astype(float)
    for _ in range(rounds if len(grid) else 0):
        gain = np.where(grid > 0, rest[grid], 0.0).sum(axis=1) / np.sqrt((grid > 0).sum(axis=1))
        gain[chosen] = 0.0
        best = np.argsort(-gain, kind="stable")[:add]
        best = best[gain[best] > 0.5]
        if not len(best):
            break
        chosen[best] = True
        at = np.flatnonzero(chosen)
        x[at] = nnls(grid[at], h.astype(float), x[at])
        rest = h.astype(float)
        for j in range(3):
            np.subtract.at(rest, grid[at, j], x[at])
        rest[0] = 0.0
    left = h.copy()
    used: list[tuple[tuple[int, ...], int]] = []
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 0.5:
            break
        lengths = [int(v) for v in grid[i] if v]
        n = min(int(x[i] + 0.5), *[int(left[v]) // lengths.count(v) for v in lengths])
        if n > 0:
            used.append((tuple(lengths), n))
            for v in lengths:
                left[v] -= n
    aside = np.zeros(window, bool)  # longest pieces that the greedy step couldn't complete
    while True:
        open_ = np.flatnonzero((left > 0) & ~aside)
        if not len(open_):
            break
        lengths, free, have = [], window, left.copy()
        while free:
            fit = np.flatnonzero(have[:free + 1] > 0) if lengths else open_
            if not len(fit):
                break
            lengths.append(int(fit[-1]))
            have[fit[-1]] -= 1
            free -= lengths[-1]
        if free:
            aside[lengths[0]] = True
            continue
        n = min(int(left[v]) // lengths.count(v) for v in set(lengths))
        used.append((tuple(lengths), n))
        for v in lengths:
            left[v] -= n
    places: dict[int, list[tuple[int, int, int]]] = {}
    taken, sequence = np.zeros(window, np.int64), 0
    for lengths, n in used:
        offset = 0
        for v in lengths:
            places.setdefault(v, []).append((int(taken[v]), sequence, offset))
            taken[v] += n
            offset += v
        sequence += n
    chain, begin = {}, 0
    for v in np.flatnonzero(left)[::-1]:
        chain[int(v)] = (int(taken[v]), begin)
        begin += int(v) * int(left[v])
    return {"places": places, "chain": chain, "chain_from": sequence, "full_from": sequence + -(-begin // window)}


_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID,
         buckets: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    m = written(measured(docs, path, window, end_id), "measured")
    order = ["doc_id", "rem_crc", "tokens", "crcs"]
    m = m.withColumn("bucket", F.pmod(F.xxhash64(*order[:3]), F.lit(buckets)).cast("int"))
    cells = m.groupBy("rem", "bucket").agg(F.count(F.lit(1)).alias("n"),
                                           F.sum(F.size("crcs").cast("long")).alias("full"))
    cells = written(cells, "cells")  # at most window * buckets rows
    histogram = {r["rem"]: r["n"] for r in cells.where("rem > 0").groupBy("rem").agg(F.sum("n").alias("n")).collect()}
    way = plan(histogram, window)
    before = (W.unboundedPreceding, -1)
    cells = cells.select("rem", "bucket",
                         F.coalesce(F.sum("n").over(W.partitionBy("rem").orderBy("bucket").rowsBetween(*before)),
                                    F.lit(0)).alias("rank0"),
                         F.coalesce(F.sum("full").over(W.orderBy("rem", "bucket").rowsBetween(*before)),
                                    F.lit(0)).alias("full0"))
    own = W.partitionBy("rem", "bucket").orderBy(*order)
    placed = m.join(cells, ["rem", "bucket"]).select(
        "doc_id", "tokens", "crcs", "rem", "rem_crc", "rem_ids",
        (F.col("rank0") + F.row_number().over(own) - 1).alias("rank"),
        (F.col("full0") + F.coalesce(F.sum(F.size("crcs").cast("long")).over(own.rowsBetween(*before)),
                                     F.lit(0))).alias("full"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {v: np.array([p[0] for p in ps]) for v, ps in way["places"].items()}
        for batch in _few(batches):
            out: list[tuple] = []
            for r in batch.to_pylist():
                doc, tokens, start = r["doc_id"], r["tokens"], len(r["crcs"]) * window
                for i, crc in enumerate(r["crcs"]):
                    out.append((doc, i * window, window, crc, tokens, way["full_from"] + r["full"] + i, 0))
                v, rank = r["rem"], r["rank"]
                if not v:
                    continue
                if v in way["chain"] and rank >= way["chain"][v][0]:
                    first, begin = way["chain"][v]
                    at = begin + (rank - first) * v
                    ids = np.frombuffer(r["rem_ids"], f"<u{len(r['rem_ids']) // v}")
                    done = 0
                    while done < v:
                        n = min(v - done, window - (at + done) % window)
                        out.append((doc, start + done, n, _crc(ids[done:done + n]), tokens,
                                    way["chain_from"] + (at + done) // window, (at + done) % window))
                        done += n
                else:
                    first, sequence, offset = way["places"][v][int(np.searchsorted(firsts[v], rank, "right")) - 1]
                    out.append((doc, start, v, r["rem_crc"], tokens, sequence + rank - first, offset))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(cut, _PIECES)
