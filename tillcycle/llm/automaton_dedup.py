"""Substring dedup: passages that an earlier document holds go, found by suffix automata.

1. Every window of ``window`` words has an anchor, the ``SEED`` words in it with the least hash
   (the leftmost, of equal ones).  Equal windows have equal anchors, so a run of windows with
   one anchor needs only the references of that anchor.  A run is one narrow row; equal runs
   of an anchor are one body, with the first document that has it.
2. Anchors that one document alone holds are done.  The words of the other bodies are fetched
   once, from the first document.  They are the references, dealt by anchor into shards of
   ``shard_words``; a suffix automaton of each shard knows for every substring the first
   document that has it.
3. Each automaton, of bounded size, is sent to the blocks of bodies that may match it, which
   stream through it for matching statistics: where a match of ``window`` words ends, the
   automaton gives the first document holding them.  Sending every automaton to every
   document would be shards x documents; the anchors say which pairs can match.
4. A run loses the windows whose first document has a smaller id than its own; documents lose
   the words covered.

An anchor whose bodies hold over ``shard_words`` words is dealt anew, window by window, by the
windows' own hashes, so no shard outgrows its bound, whatever the number of near copies.

Defined cases: a null text has no words; texts shorter than the window stay whole; null ids
come after all others and are equal among themselves; rows that share an id don't remove each
other's words; rows are told apart by id and a hash of the text; other columns are not read.
Bodies are told apart by 128 bits of hash, words in the automata by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.llm.automaton import SuffixAutomaton
from tillcycle.llm.common import written
from tillcycle.llm.repeats import anchored, folded

WINDOW, SEED, SHARD_WORDS, CACHE = 50, 8, 1 << 17, 1 << 20
LAST = (1 << 63) - 1
_RUN = "anchor long, body long, doc long, row long, begin int, size int"


class WordHashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _seed(window: int) -> int:
    """Words of a seed: a power of two, a sixth of the window about."""
    return max(1, min(SEED, 1 << (max(1, window // 4).bit_length() - 1)))


def _find_runs(window: int):
    seed = _seed(window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, digest = WordHashes(), xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode().split()
                n = len(words) - window + 1
                if n <= 0:
                    continue
                h = word_hashes(words, known)
                first, last, _, anchor = anchored(folded(h, seed), n, window - seed + 1)
                size = last - first + window
                out[0].append(anchor.view(np.int64))
                out[1].append(np.array([digest(h[a:a + s].data) for a, s in zip(first.tolist(), size.tolist())],
                                       np.uint64).view(np.int64))
                out[2].append(np.full(len(first), doc, np.int64))
                out[3].append(np.full(len(first), row, np.int64))
                out[4].append(first.astype(np.int32))
                out[5].append(size.astype(np.int32))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                                 names=["anchor", "body", "doc", "row", "begin", "size"])
    return scan


_ASK = "anchor long, body long, begin int, size int, large boolean"
_PART = "k long, anchor long, body long, at int, doc long, size int, large boolean, words binary"
_PART_ARROW = pa.schema([("k", pa.int64()), ("anchor", pa.int64()), ("body", pa.int64()), ("at", pa.int32()),
                         ("doc", pa.int64()), ("size", pa.int32()), ("large", pa.bool_()), ("words", pa.binary())])


def _fetch(window: int):
    """(doc, text, asked bodies) to one row a body with its words, or to one row for each of
    its windows where the anchor is large."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for doc, text, asked in zip(*(c.to_pylist() for c in batch.columns)):
                words, out = text.encode().split(), []
                for r in asked:
                    own, key = words[r["begin"]:r["begin"] + r["size"]], (r["anchor"], r["body"])
                    if r["large"]:
                        for at in range(len(own) - window + 1):
                            part = b" ".join(own[at:at + window])
                            k = digest(part)
                            out.append((k - (1 << 64) if k > LAST else k, *key, at, doc, window, True, part))
                    else:
                        out.append((r["anchor"], *key, 0, doc, len(own), False, b" ".join(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PART_ARROW)],
                                                 schema=_PART_ARROW)
    return run


_PIECE = "anchor long, body long, a int, b int, doc long"
_PIECE_NAMES = ["anchor", "body", "a", "b", "first"]
_PIECE_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
REFERENCE, BOTH, STREAM = 0, 1, 2


def _stream(window: int):
    """Rows sorted by (shard, block, role): a shard's references make its automaton, then its
    streams pass through it.  Yields pieces: the windows [a, b) of a body and the first document
    that has them."""
    def pieces(automaton: SuffixAutomaton, anchor: int, body: int, at: int, words: list[bytes], out: list) -> None:
        held = automaton.statistics(words, window)[window - 1:]
        a = 0
        for b in range(1, len(held) + 1):
            if b == len(held) or held[b] != held[a]:
                if held[a] is not None:
                    out.append((anchor, body, at + a, at + b, held[a]))
                a = b

    def batch_of(out: list) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PIECE_TYPES)], names=_PIECE_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, automaton, closed, waiting = None, SuffixAutomaton(), False, []
        out: list[tuple] = []

        def settle():
            automaton.close()
            for row in waiting:
                pieces(automaton, *row, out)

        for batch in batches:
            for shard, block, role, anchor, body, at, doc, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, block) != place:
                    if place is not None and not closed:
                        settle()
                    place, automaton, closed, waiting = (shard, block), SuffixAutomaton(), False, []
                own = words.split()
                if role != STREAM:
                    automaton.add(own, doc)
                    if role == BOTH:
                        waiting.append((anchor, body, at, own))
                    continue
                if not closed:
                    settle()
                    closed, waiting = True, []
                pieces(automaton, anchor, body, at, own, out)
            yield batch_of(out)
            out = []
        if place is not None and not closed:
            settle()
        yield batch_of(out)

    return run


def first_holders(bodies: DataFrame, texts: DataFrame, window: int, shard_words: int) -> DataFrame:
    """The pieces of the bodies (anchor, body, size, first, words), words being their anchor's:
    (anchor, body, a, b, first): the first document that holds the windows [a, b) of a body."""
    asked = (bodies.select("anchor", "body", F.col("first.doc").alias("ask_doc"), F.col("first.row").alias("ask_row"),
                           F.col("first.begin").alias("begin"), "size", (F.col("words") > shard_words).alias("large"))
             .groupBy("ask_doc", "ask_row")
             .agg(F.collect_list(F.struct("anchor", "body", "begin", "size", "large")).alias("asked")))
    parts = written(
        texts.join(asked, (F.col("doc") == F.col("ask_doc")) & (F.col("row") == F.col("ask_row")))
        .dropDuplicates(["doc", "row"]).select("doc", "text", "asked").mapInArrow(_fetch(window), _PART), "parts")
    sizes = parts.agg(F.sum(F.when(~F.col("large"), F.col("size"))).alias("small"),
                      F.sum(F.when(F.col("large"), F.col("size"))).alias("large")).first()
    dealt = lambda words: F.pmod(F.xxhash64("k"), F.lit(-(-(words or 0) // shard_words) or 1))
    # of an anchor every body is reference and stream
    rows = parts.where("not large").select(
        dealt(sizes["small"]).alias("shard"), F.lit(0).cast("long").alias("block"), F.lit(BOTH).alias("role"),
        "anchor", "body", "at", "doc", "words")
    if sizes["large"]:
        # equal windows are one reference; a shard's windows stream in blocks, each with a copy of the references
        large = parts.where("large").withColumn("shard", -1 - dealt(sizes["large"]))
        blocks = large.groupBy("shard").agg(
            F.ceil(F.count(F.lit(1)) * window / (4 * shard_words)).cast("long").alias("blocks"))
        refs = large.groupBy("shard", "words").agg(F.min("doc").alias("doc")).join(blocks, "shard").select(
            "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
            F.lit(REFERENCE).alias("role"), F.lit(None).cast("long").alias("anchor"),
            F.lit(None).cast("long").alias("body"), F.lit(0).alias("at"), "doc", "words")
        streams = large.join(blocks, "shard").select(
            "shard", F.pmod(F.xxhash64("body", "at"), "blocks").alias("block"), F.lit(STREAM).alias("role"),
            "anchor", "body", "at", "doc", "words")
        rows = rows.unionByName(refs).unionByName(streams)
    return written(rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "role")
                   .mapInArrow(_stream(window), _PIECE.replace("doc", "first")), "pieces")


def repeated_spans(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc, row, begin, end): words covered by windows that a document of a smaller id holds.
    doc: the id, ``LAST`` for null; row: a hash of the text."""
    texts = docs.where("text is not null").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("row"), "text")
    found = written(texts.mapInArrow(_find_runs(window), _RUN), "runs")
    bodies = found.groupBy("anchor", "body").agg(
        F.min(F.struct("doc", "row", "begin")).alias("first"), F.max("doc").alias("last"), F.first("size").alias("size"))
    anchors = (bodies.groupBy("anchor").agg(F.min("first.doc").alias("least"), F.max("last").alias("most"),
                                            F.sum("size").alias("words")).where("least < most"))
    shared = written(bodies.join(anchors, "anchor").select("anchor", "body", "size", "first", "words"), "bodies")
    pieces = first_holders(shared, texts, window, shard_words)
    return (found.join(pieces, ["anchor", "body"]).where("first < doc")
            .select("doc", "row", (F.col("begin") + F.col("a")).alias("begin"),
                    (F.col("begin") + F.col("b") + (window - 1)).alias("end")))


_LEFT = "doc_id long, n_words long, n_removed long, kept string, text string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, gone, kept, left = [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = text.encode().split()
            stay, end = [], 0
            for s in sorted(spans or [], key=lambda s: (s["begin"], s["end"])):
                stay += words[end:s["begin"]]
                end = max(end, s["end"])
            stay += words[end:]
            n_words.append(len(words))
            gone.append(len(words) - len(stay))
            kept.append(b" ".join(stay).decode())
            left.append(text if len(stay) == len(words) else kept[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
             pa.array(left, pa.string())], names=["doc_id", "n_words", "n_removed", "kept", "text"])


def remove_repeats(docs: DataFrame, **kw) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, the kept words joined by a space, and
    the text that is left: as it was where nothing was removed, else the kept words."""
    spans = (repeated_spans(docs, **kw).groupBy("doc", "row")
             .agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
             .withColumnRenamed("doc", "span_doc").withColumnRenamed("row", "span_row"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("row", F.xxhash64("text"))
    both = d.join(spans, (F.col("doc") == F.col("span_doc")) & (F.col("row") == F.col("span_row")), "left")
    return both.select("doc_id", "text", "spans").mapInArrow(_remove, _LEFT)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(doc_id, 9223372036854775807) AS o,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, o, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
keyed AS (SELECT r, o, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM win),
first AS (SELECT k, min(o) AS o FROM keyed GROUP BY k),
hit AS (SELECT keyed.r, keyed.i FROM keyed JOIN first ON keyed.k = first.k AND first.o < keyed.o),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
seen AS (SELECT word.r, word.i, word.word,
                coalesce(max(hit.i) OVER (PARTITION BY word.r ORDER BY word.i) >= word.i - 49, false) AS gone
         FROM word LEFT JOIN hit ON hit.r = word.r AND hit.i = word.i),
kept AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed,
                string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS text FROM seen GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256,
       CASE WHEN n_removed > 0 THEN coalesce(kept.text, '') ELSE coalesce(d.text, '') END AS text, length(CASE WHEN n_removed > 0 THEN coalesce(kept.text, '') ELSE coalesce(d.text, '') END)::BIGINT AS n_chars
FROM d LEFT JOIN kept ON d.r = kept.r
"""
