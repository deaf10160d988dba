"""SimHash near-dedup by a segment-popcount embedding.

Each 64-bit fingerprint is mapped to the bit counts of its 2-bit segments.  The Manhattan
distance of two such vectors never exceeds the number of differing bits, so a grid range
join over the vectors finds every pair that may link: at most ``max_bits`` = 4 differing bits
leave one half of the vector (16 segments) within distance 2, and two points within distance
2 on the grid have a common cell among their own and the cells one step away.  Every
fingerprint is therefore filed under its own cell and its neighbours in either half, and
pairs that meet are verified by their exact bit distance.

Only distinct fingerprints are compared.  Of a cell's verified links a spanning forest is
kept, which has the same components with fewer rows than the cell has members; a cell with
over ``max_cell`` members is split in chunks and processed by pairs of chunks, all of them.

Random fingerprints meet with a probability near 7e-5 a pair, so the comparisons in the
cells, unlike shuffles and edges, grow with the square of the distinct fingerprints.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any
other; rows with the same doc_id are classed by their own texts; null doc_ids are never a
component's id (null only if the component has no other).  Columns but doc_id and text are
not read, except that `keep_first` tells rows apart by all columns; rows equal in all are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.llm.common import row_hashes, unused, written
from tillcycle.llm.graph import components

SHINGLE, MAX_BITS, SEED, MAX_CELL = 4, 4, 42, 20_000
SEGMENTS = 16  # 2-bit segments of one half


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of the whole text, as an unsigned 64-bit number."""
    norm = b" ".join((text or "").encode().lower().split())  # ASCII white space and letters only
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    if len(gaps) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(norm, SEED)], np.uint64)
    else:
        starts = [0, *(gaps[:len(gaps) - shingle + 1] + 1).tolist()]
        ends = [*gaps[shingle - 1:].tolist(), len(norm)]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(norm[s:e], SEED) for s, e in zip(starts, ends, strict=True)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i:i + (1 << 14)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long, per row; then the long columns ``also``."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]],
                                             names=["doc_id", "fp", *also])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *also)
            .mapInArrow(scan, ", ".join(f"{c} long" for c in ("doc_id", "fp", *also))))


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of the fingerprint): own cell and neighbours, in both halves."""
    cell_parts, at_parts = [], []
    weights = 3 ** np.arange(SEGMENTS, dtype=np.int64)
    shifts = np.arange(0, 2 * SEGMENTS, 2, dtype=np.uint64)
    for half in (0, 1):
        word = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        counts = np.bitwise_count((word[:, None] >> shifts) & np.uint64(3)).astype(np.int64)
        own = counts @ weights + half * 3 ** SEGMENTS
        cell_parts.append(own)
        at_parts.append(np.arange(len(fps)))
        for step, allowed in ((1, counts < 2), (-1, counts > 0)):
            row, seg = np.nonzero(allowed)
            cell_parts.append(own[row] + step * weights[seg])
            at_parts.append(row)
    return np.concatenate(cell_parts), np.concatenate(at_parts)


def spanning_edges(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Pairs of indexes within ``max_bits``, enough to connect all that such pairs connect:
    each point found is compared with the points not reached yet."""
    left = np.arange(len(fps))
    edges: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[u]) <= max_bits
            if near.any():
                found = left[near].tolist()
                edges += [(u, v) for v in found]
                queue += found
                left = left[~near]
    return edges


def _links(max_bits: int, max_cell: int | None):
    """Reads (c1, c2, c3, fp) sorted by cell; yields links (a, b), and for a cell over
    ``max_cell`` the row (its number, null)."""
    def of_groups(cells: np.ndarray, fps: np.ndarray):
        """Whole cells only."""
        cut = np.flatnonzero(np.any(cells[1:] != cells[:-1], axis=1)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(fps)]])
        sizes = ends - starts
        a_parts, b_parts = [], []
        group = np.repeat(np.arange(len(starts)), sizes)
        small = sizes[group] <= 8
        idx = np.flatnonzero(small)
        for d in range(1, 8):  # all pairs of small cells, by distance in the order
            i = idx[idx + d < len(fps)]
            i = i[group[i + d] == group[i]]
            near = np.bitwise_count(fps[i] ^ fps[i + d]) <= max_bits
            a_parts.append(fps[i[near]])
            b_parts.append(fps[i[near] + d])
        for g in np.flatnonzero(sizes > 8):
            own = fps[starts[g]:ends[g]]
            if len(own) <= 1024:
                x, y = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= max_bits, 1))
                if len(x) > len(own):
                    x, y = np.array(spanning_edges(own, max_bits)).T
            else:
                found = spanning_edges(own, max_bits)
                x, y = np.array(found).T if found else (np.empty(0, int), np.empty(0, int))
            a_parts.append(own[x])
            b_parts.append(own[y])
        return np.concatenate(a_parts), np.concatenate(b_parts)

    def batch_of(a, b, b_null=False):
        b = pa.nulls(len(a), pa.int64()) if b_null else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_c, held_f, skip = np.empty((0, 3), np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            c = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            f = batch.column(3).to_numpy().view(np.uint64)
            if skip is not None:
                rest = np.any(c != skip, axis=1)
                c, f = c[rest], f[rest]
            held_c, held_f = np.concatenate([held_c, c]), np.concatenate([held_f, f])
            if not len(held_f):
                continue
            last = held_c[-1]
            whole = int(np.argmax(np.all(held_c == last, axis=1)))
            if whole:
                yield batch_of(*of_groups(held_c[:whole], held_f[:whole]))
                held_c, held_f = held_c[whole:], held_f[whole:]
            if max_cell and len(held_f) > max_cell:
                skip = last
                yield batch_of(np.array([last[0]], np.int64).view(np.uint64), None, True)
                held_c, held_f = held_c[:0], held_f[:0]
        if len(held_f):
            yield batch_of(*of_groups(held_c, held_f))

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, max_cell: int = MAX_CELL) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fps.fp`` with the components of all."""
    if max_bits > 4:
        raise ValueError("cells cover at most 4 differing bits")

    def file_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            cell, at = cells_of(f)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(f[at].view(np.int64))], names=["cell", "fp"])

    cells = fps.select("fp").mapInArrow(file_cells, "cell long, fp long")
    one = cells.select(F.col("cell").alias("c1"), F.lit(0).cast("long").alias("c2"), F.lit(0).cast("long").alias("c3"), "fp")
    found = written(one.repartition("c1").sortWithinPartitions("c1")
                    .mapInArrow(_links(max_bits, max_cell), "a long, b long"), "links")
    pairs, large = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("cell")).distinct()
    if not large.isEmpty():
        big = cells.join(large, "cell")
        n = big.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * 2 / max_cell).cast("long").alias("chunks"))
        dealt = big.join(n, "cell").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        dealt = dealt.select(F.col("cell").alias("c1"), F.least("own", "other").alias("c2"),
                             F.greatest("own", "other").alias("c3"), "fp")
        pairs = pairs.unionByName(
            dealt.repartition("c1", "c2", "c3").sortWithinPartitions("c1", "c2", "c3")
            .mapInArrow(_links(max_bits, None), "a long, b long"))
    return pairs


def _rooted(classes: DataFrame, max_bits: int, max_cell: int) -> DataFrame:
    """``classes``, one row per fingerprint ``fp``, with the ``root`` of its component; never null."""
    roots = components(links(classes, max_bits, max_cell))
    return (classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
            .withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                    max_cell: int = MAX_CELL) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the smallest doc_id reachable."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    named = _rooted(classes, max_bits, max_cell)
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = named.join(lowest, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS,
               max_cell: int = MAX_CELL) -> DataFrame:
    """One row of each component, of those with doc_id if there are any: the first by doc_id,
    then by fingerprint, then by a hash of the row.  Rows that share a doc_id, or have none,
    are judged each by its own text."""
    key = tuple(unused(docs, "row1", "row2"))
    keyed = docs.withColumns(dict(zip(key, row_hashes(docs), strict=True)))
    fps = written(fingerprints(keyed, shingle, key), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", *key)).alias("first")), "classes")
    stay = (_rooted(classes, max_bits, max_cell).groupBy("root")
            .agg(F.min(F.struct("first.no_id", "first.doc_id", "fp", *[f"first.{k}" for k in key])).alias("first"))
            .select(*[f"first.{k}" for k in key]))
    return keyed.join(stay, list(key), "left_semi").dropDuplicates(list(key)).drop(*key)
