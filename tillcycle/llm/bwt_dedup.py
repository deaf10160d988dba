"""Suffix-array dedup of repeated byte strings by merging shard Burrows-Wheeler transforms.

1. Each document's windows are dealt into runs by their anchors (`repeats.runs`); equal
   windows always lie in runs with the same anchor hash.  A run is one narrow row; runs that
   one batch holds twice are settled there, so hot passages are pre-aggregated.
2. Runs meet by anchor hash, sorted and streamed.  Runs with equal bytes are repeated as a
   whole.  Where an anchor has runs that differ, one of each goes on, with its bytes.
3. The runs of an anchor are trimmed to what any other shares with them at most (neighbours
   in suffix order give that), equal remainders are merged, and what is left is cut in
   shards of ``shard_bytes``: each shard's suffixes are sorted once, and the transforms are
   merged by interleave refinement (`repeats`), whose open intervals are the windows that
   start anywhere else.  A merge holds about 90 bytes for each of its own, so it takes
   ``batch_bytes``, or one anchor of at most ``max_merge`` bytes trimmed.  An anchor above
   that, or with over ``max_group`` bytes of runs, is split in chunks, and all pairs of
   chunks are processed.
4. The bytes covered by repeated windows are removed, document by document.

Defined cases: a null text is empty; matches never cross rows, and repeated rows are
documents of their own, so all their windows repeat; texts shorter than the window stay as
they are; rows are told apart by doc_id and the text's checksum; other columns are not read.
Blocks and runs are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.llm.common import written
from tillcycle.llm.repeats import extents, repeated_windows, runs

WINDOW, SHARD_BYTES, BATCH_BYTES, MAX_GROUP, MAX_MERGE = 400, 1 << 19, 1 << 20, 16 << 20, 2 << 20
#: A run: anchor hash, hash of its bytes, how often seen (2: twice or more), its document
#: (doc_id, checksum of the text), first byte, length, bytes before the anchor.
_RUN = "anchor long, body long, doc_id long, crc long, begin int, size int, lead int, seen int"
_RUN_NAMES = ["anchor", "body", "doc_id", "crc", "begin", "size", "lead", "seen"]
_RUN_ARROW = pa.schema([(n, pa.int64() if n in _RUN_NAMES[:4] else pa.int32()) for n in _RUN_NAMES])
_SPAN = "doc_id long, crc long, begin int, size int"


def _arrow(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()],
                                      names=list(columns))


def _find_runs(window: int):
    """Rows of _RUN; a row with anchor null is a span known to be repeated."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            anchors, bodies, owner, crcs, begins, sizes, leads = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = (text or "").encode()
                first, last, at, h = runs(np.frombuffer(raw, np.uint8), window)
                if not len(first):
                    continue
                ends = last + window
                bodies += [digest(raw[a:b]) for a, b in zip(first.tolist(), ends.tolist())]
                anchors.append(h)
                begins.append(first)
                sizes.append(ends - first)
                leads.append(at - first)
                owner.append(np.full(len(first), i))
                crcs.append(np.full(len(first), zlib.crc32(raw)))
            if not anchors:
                continue
            anchor = np.concatenate(anchors).view(np.int64)
            body = np.array(bodies, np.uint64).view(np.int64)
            begin, size, lead = (np.concatenate(x).astype(np.int32) for x in (begins, sizes, leads))
            doc, crc = batch.column(0).take(pa.array(np.concatenate(owner))), np.concatenate(crcs)
            order = np.lexsort((body, anchor))
            fresh = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1])
                                    | (body[order][1:] != body[order][:-1])])
            group = np.cumsum(fresh) - 1
            twice = np.bincount(group)[group] > 1
            go = order[fresh]
            yield _arrow({"anchor": anchor[go], "body": body[go], "doc_id": doc.take(pa.array(go)), "crc": crc[go],
                          "begin": begin[go], "size": size[go], "lead": lead[go],
                          "seen": np.where(twice[fresh], 2, 1).astype(np.int32)})
            known = order[twice]
            yield _arrow({"anchor": pa.nulls(len(known), pa.int64()), "body": body[known],
                          "doc_id": doc.take(pa.array(known)), "crc": crc[known], "begin": begin[known],
                          "size": size[known], "lead": lead[known], "seen": np.full(len(known), 2, np.int32)})
    return scan


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (anchor, body), known spans first: yields spans (seen = 2) and, for
    anchors with runs that differ, one run of each kind (seen = 0, or -1 if it is repeated).
    Between batches it holds one row: the kind that may go on."""
    held = pd.DataFrame()
    several = None  # the held kind's anchor, if other kinds of it went before

    def rows(df: pd.DataFrame) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(df[_RUN_NAMES], schema=_RUN_ARROW, preserve_index=False)

    def kinds(df: pd.DataFrame, going_on) -> pd.DataFrame:
        """One row of each kind in df, of the anchors with several kinds; going_on: the anchor
        of the kind held back."""
        per = df.groupby("anchor", sort=False)["seen"]
        n, open_ = per.transform("size"), df["anchor"].isin([x for x in (several, going_on) if x is not None])
        undone = per.transform("min") == 1
        one = df[(open_ | ((n > 1) & undone))]
        return one.assign(seen=np.where(one["seen"] > 1, -1, 0))

    for batch in batches:
        known = batch.filter(batch.column(0).is_null())
        if len(known):
            yield known
        df = batch.filter(batch.column(0).is_valid()).to_pandas()
        if not len(df):
            continue
        df["doc_id"] = df["doc_id"].astype("Int64")
        df["told"] = False
        df = pd.concat([held, df], ignore_index=True)
        total = df.groupby(["anchor", "body"], sort=False)["seen"].transform("sum")
        spans = df[(total > 1) & (df["seen"] == 1) & ~df["told"].astype(bool)]
        if len(spans):
            yield rows(spans.assign(seen=2))
        df["told"] = total > 1
        df["seen"] = np.minimum(total, 2)
        df = df.drop_duplicates(["anchor", "body"])
        held = df.iloc[-1:]
        going_on, done = held["anchor"].iloc[0], df.iloc[:-1]
        if len(done):
            yield rows(kinds(done, going_on))
        several = going_on if several == going_on or (done["anchor"] == going_on).any() else None
    if len(held):
        yield rows(kinds(held, None))


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, doc_id, crc, asked runs) to one row a run, with its bytes."""
    for batch in batches:
        for text, doc, crc, asked in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            rows = [(r["anchor"], doc, crc, r["begin"], r["lead"], r["seen"], raw[r["begin"]:r["begin"] + r["size"]])
                    for r in asked]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(),
                                                             pa.int32(), pa.int32(), pa.binary()))],
                names=["anchor", "doc_id", "crc", "begin", "lead", "seen", "bytes"])


def _trimmed(group: list[tuple], window: int):
    """The runs of one anchor, trimmed: {string: [(doc_id, crc, first byte, seen)]}."""
    right = extents([r[5][r[3]:] for r in group])
    left = extents([r[5][:r[3]][::-1] for r in group])
    out: dict[bytes, list[tuple]] = {}
    for r, before, after in zip(group, left, right):
        if before + after >= window:
            doc, crc, begin, lead, seen, raw = r
            out.setdefault(raw[lead - before:lead + after], []).append((doc, crc, begin + lead - before, seen))
    return out


def _groups(batches: Iterator[pa.RecordBatch], max_group: int | None):
    """Rows sorted by their three keys to (keys, rows); rows null: over ``max_group`` bytes."""
    key, group, size = None, [], 0
    for batch in batches:
        for k1, k2, k3, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (k1, k2, k3) != key:
                if key:
                    yield key, group
                key, group, size = (k1, k2, k3), [], 0
            if group is None:
                continue
            group.append(tuple(row))
            size += len(row[5])
            if max_group and size > max_group:
                group = None
    if key:
        yield key, group


def _search(window: int, shard_bytes: int, batch_bytes: int, max_group: int | None, max_merge: int | None):
    """Rows (k1, k2, k3, doc_id, crc, begin, lead, seen, bytes) sorted by the three keys, the
    first of which is the anchor, to repeated spans; size null: the anchor (in crc) is large."""
    def spans_of(trimmed: list[dict[bytes, list[tuple]]]) -> pa.RecordBatch:
        strings = [s for group in trimmed for s in group]
        owners = [rows for group in trimmed for rows in group.values()]
        out = []
        for flags, rows in zip(repeated_windows(strings, window, shard_bytes), owners):
            at = np.flatnonzero(flags) if len(rows) == 1 else np.arange(len(flags))
            if not len(at):
                continue
            cut = np.flatnonzero(np.diff(at) > 1)
            firsts, lasts = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
            for doc, crc, begin, seen in rows:
                if seen == 0:
                    out += [(doc, crc, begin + int(a), int(b - a) + window) for a, b in zip(firsts, lasts)]
        return _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
            pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "crc", "begin", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[dict[bytes, list[tuple]]] = []
        ready_size = 0
        for (anchor, *_), group in _groups(batches, max_group):
            trimmed = {} if group is None else _trimmed(group, window)
            size = sum(map(len, trimmed))
            if group is None or (max_merge and size > max_merge):
                yield _rows([(None, anchor, 0, None)])
                continue
            if ready and ready_size + size > batch_bytes:
                yield spans_of(ready)
                ready, ready_size = [], 0
            ready.append(trimmed)
            ready_size += size
        if ready:
            yield spans_of(ready)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
                   batch_bytes: int = BATCH_BYTES, max_group: int = MAX_GROUP, max_merge: int = MAX_MERGE) -> DataFrame:
    """(doc_id, crc, begin, size): spans, overlaps included, that cover every window of
    ``window`` bytes which also starts anywhere else."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    settled = written(
        d.mapInArrow(_find_runs(window), _RUN)
        .repartition(F.coalesce(F.col("anchor"), F.xxhash64("doc_id", "begin")))
        .sortWithinPartitions("anchor", "body").mapInArrow(_settle, _RUN), "runs")
    asked = (settled.where("seen <= 0").groupBy("doc_id", "crc")
             .agg(F.collect_list(F.struct("anchor", "begin", "size", "lead", "seen")).alias("asked"))
             .withColumnRenamed("doc_id", "ask_id").withColumnRenamed("crc", "ask_crc"))
    keyed = d.where("text is not null").withColumn("crc", F.crc32(F.col("text").cast("binary")))
    # repeated rows ask once: their runs have equal bytes, so which of them answers is the same
    texts = keyed.join(asked, F.col("doc_id").eqNullSafe(F.col("ask_id")) & (F.col("crc") == F.col("ask_crc")))
    bytes_of = texts.select("text", "doc_id", "crc", "asked").mapInArrow(
        _fetch, "anchor long, doc_id long, crc long, begin int, lead int, seen int, bytes binary")
    zero = F.lit(0).cast("long")
    rows = ["doc_id", "crc", "begin", "lead", "seen", "bytes"]
    fetched = written(bytes_of, "bytes")
    found = written(
        fetched.select(F.col("anchor").alias("k1"), zero.alias("k2"), zero.alias("k3"), *rows)
        .repartition("k1").sortWithinPartitions("k1")
        .mapInArrow(_search(window, shard_bytes, batch_bytes, max_group, max_merge), _SPAN), "spans")
    spans = settled.where("seen = 2").select("doc_id", "crc", "begin", "size").unionByName(
        found.where("size is not null"))
    large = found.where("size is null").select(F.col("crc").alias("anchor")).distinct()
    if not large.isEmpty():
        big = fetched.join(large, "anchor")
        chunks = big.groupBy("anchor").agg(
            F.ceil(F.sum(F.length("bytes")) * 4 / min(max_group, max_merge)).cast("long").alias("chunks"))
        dealt = (big.join(chunks, "anchor").withColumn("own", F.pmod(F.xxhash64("bytes"), F.col("chunks")))
                 .withColumn("other", F.explode(F.sequence(zero, F.col("chunks") - 1))))
        dealt = dealt.select(F.col("anchor").alias("k1"), F.least("own", "other").alias("k2"),
                             F.greatest("own", "other").alias("k3"), *rows)
        spans = spans.unionByName(
            dealt.repartition("k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3")
            .mapInArrow(_search(window, shard_bytes, batch_bytes, None, None), _SPAN))
    return spans


def union_of(begins, sizes) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) covered by the spans; touching spans are one run."""
    out: list[list[int]] = []
    for b, s in sorted(zip(begins, sizes)):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + s)
        else:
            out.append([b, b + s])
    return [tuple(x) for x in out]


_REMOVED = "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary, text string"


def remove_repeats(docs: DataFrame, **kw) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, the maximal removed spans, the
    remaining bytes (which may cut a code point), and the text they make (U+FFFD for a cut one)."""
    spans = (repeated_spans(docs, **kw).groupBy("doc_id", "crc")
             .agg(F.collect_list(F.struct("begin", "size")).alias("spans"))
             .withColumnRenamed("doc_id", "span_id").withColumnRenamed("crc", "span_crc"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("crc", F.crc32(F.col("text").cast("binary")))
    both = d.join(spans, F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("crc") == F.col("span_crc")), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, gone, out, kept = [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode()
                cuts = union_of([s["begin"] for s in spans], [s["size"] for s in spans]) if spans else []
                ends = [0, *[e for _, e in cuts]]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*[b for b, _ in cuts], len(raw)])))
                sizes.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                out.append([{"begin": b, "end": e} for b, e in cuts])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, kind),
                 pa.array(kept, pa.binary()), pa.array([k.decode(errors="replace") for k in kept], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "text"])

    return both.select("doc_id", "text", "spans").mapInArrow(remove, _REMOVED)
