"""Ranked lexical search: best-first document intervals bounded by range maxima of postings.

1. Each task indexes its documents in shards of about ``shard_terms`` terms: for every term the
   places of its documents (ordered by id) and how often they hold it.  No posting is shuffled
   to build the index; it covers all documents and all terms.
2. Terms of the items get their weights from the document counts of all shards.  Shards are
   dealt into lanes, and the items, in blocks of ``block_items``, are sent to every lane.
3. A shard's posting lists carry sparse tables for range maxima of impact.  An interval of
   documents is bounded by the sum, over the item's terms, of weight times the greatest impact
   in the interval.  Intervals are taken in the order of their bounds and split at the document
   of the term with the greatest share of the bound, which is scored whole; an interval with at
   most ``leaf`` postings left is scored at once.  A lane goes on from shard to shard with its
   items' k-th scores, and intervals that can't reach them are dropped.
4. The best k of all lanes are ranked.

A document's score for an item is the sum of weight * impact over the item's terms, repeats
included, with weight floor(1000 * ln((2N + 2) / (2 df + 1))) and impact
(10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L; n, tf count terms in the document, N
documents with a term, L all their terms, df documents with the term.

Defined cases: null texts have no terms; an item without terms, or whose terms no document has,
has no rows; rows that share an item_id are one item; each row of the documents is a document
of its own, also if it repeats another; documents without id come last among equal scores;
other columns are not read.  A task holds the postings of one shard (one document more than
``shard_terms`` terms at most) and one block of items.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillcycle.llm.common import written

K, SHARD_TERMS, LANE_POSTINGS, BLOCK_ITEMS, LEAF = 20, 1 << 20, 1 << 20, 4096, 1024
LAST = (1 << 63) - 1
#: ASCII letters and digits are kept, A-Z lower-cased, other ASCII parts terms.
_ASCII = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
_PLACE_BITS = 40


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_ASCII).split()


# ---- the index
_INDEX = "shard long, term string, ids binary, counts binary, n long"
_INDEX_NAMES = ["shard", "term", "ids", "counts", "n"]
_INDEX_TYPES = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64())


def _index_rows(shard: int, ids: list[int], found: list[Counter]) -> pa.RecordBatch:
    """A shard: one row without term (document ids in order, their numbers of terms), then one
    row a term (places of its documents, how often they hold it)."""
    by_id = np.argsort(np.array(ids, np.int64), kind="stable")
    names: dict[bytes, int] = {}
    sizes = np.array([len(c) for c in found])
    term = np.fromiter((names.setdefault(t, len(names)) for c in found for t in c), np.int64, int(sizes.sum()))
    count = np.fromiter((n for c in found for n in c.values()), np.int32, len(term))
    rank = np.empty(len(ids), np.int32)
    rank[by_id] = np.arange(len(ids))
    place = np.repeat(rank, sizes)
    order = np.lexsort((place, term))
    place, count = place[order], count[order]
    ends = np.cumsum(np.bincount(term, minlength=len(names)))
    lengths = np.array([sum(c.values()) for c in found], np.int32)
    rows = [(shard, None, np.array(ids, np.int64)[by_id].tobytes(), lengths[by_id].tobytes(), len(ids))]
    a = 0
    for t, b in zip(names, ends.tolist()):
        rows.append((shard, t.decode(), place[a:b].tobytes(), count[a:b].tobytes(), b - a))
        a = b
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES)], names=_INDEX_NAMES)


def _build(shard_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, found, size = TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = terms_of(text)
                if not words:
                    continue
                ids.append(doc)
                found.append(Counter(words))
                size += len(words)
                if size >= shard_terms:
                    yield _index_rows(shard, ids, found)
                    shard, ids, found, size = shard + 1, [], [], 0
        if ids:
            yield _index_rows(shard, ids, found)
    return run


def index(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    return written(docs.where("text is not null").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
        .mapInArrow(_build(shard_terms), _INDEX), "index")


# ---- the search of a shard
class Shard:
    """Posting lists behind one another, each with a sparse table.  ``keys``: term * documents +
    place, ascending.  ``top[j, i]``: of the 2^j postings from i on the greatest impact, and the
    first place in the lists that has it (as a complement, in the low bits)."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]],
                 n_docs: int, n_terms: int):
        self.ids, self.n = ids, len(ids)
        m = 75 + 25 * lengths.astype(np.int64) * n_docs // n_terms
        sizes = np.array([len(p) for p, _ in lists], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        place = np.concatenate([p for p, _ in lists]).astype(np.int64)
        tf = np.concatenate([c for _, c in lists]).astype(np.int64)
        self.keys = np.repeat(np.arange(len(lists)), sizes) * self.n + place
        self.impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[place])
        self.mask = (1 << _PLACE_BITS) - 1
        levels = [self.impact << _PLACE_BITS | (self.mask - np.arange(len(place)))]
        step = 1
        while 2 * step <= sizes.max():
            last, up = levels[-1], levels[-1].copy()
            np.maximum(last[:-step], last[step:], out=up[:-step])
            levels.append(up)
            step *= 2
        self.top = np.stack(levels)
        self.log = np.zeros(int(sizes.max()) + 1, np.int64)
        for j in range(1, len(levels)):
            self.log[1 << j:] = j

    def maxima(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Range maxima of [a, b), as in ``top``; 0 for empty ranges."""
        some = np.flatnonzero(a < b)
        out = np.zeros(len(a), np.int64)
        lo, hi = a[some], b[some]
        j = self.log[hi - lo]
        out[some] = np.maximum(self.top[j, lo], self.top[j, hi - (1 << j)])
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int, leaf: int) -> int:
        """Carries ``best``, a heap of up to k (score, -id), over this shard's documents; returns
        how many documents were scored."""
        todo, scored, turn = [], 0, 0
        base = terms * self.n

        def offer(score: int, doc: int) -> None:
            entry = (score, -doc)
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)

        def out_of_reach(bound: int, a: np.ndarray, b: np.ndarray) -> bool:
            if len(best) < k or bound > best[0][0]:
                return bound <= 0
            if bound < best[0][0]:
                return True
            some = a < b  # a tie counts for smaller ids only
            return int(self.ids[(self.keys[a[some]] - base[some]).min()]) > -best[0][1]

        def push(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal turn
            top = self.maxima(a, b)
            bound = int((weights * (top >> _PLACE_BITS)).sum())
            if bound > 0 and not out_of_reach(bound, a, b):
                heapq.heappush(todo, (-bound, turn, a, b, top))
                turn += 1

        push(self.starts[terms], self.ends[terms])
        while todo:
            bound, _, a, b, top = heapq.heappop(todo)
            if len(best) == k and -bound < best[0][0]:
                break
            if out_of_reach(-bound, a, b):
                continue
            sizes = b - a
            total = int(sizes.sum())
            if total <= leaf:
                which = np.repeat(np.arange(len(terms)), sizes)
                at = np.arange(total) + (a - (np.cumsum(sizes) - sizes))[which]
                docs, inverse = np.unique(self.keys[at] - base[which], return_inverse=True)
                scores = np.zeros(len(docs), np.int64)
                np.add.at(scores, inverse, weights[which] * self.impact[at])
                scored += len(docs)
                low = best[0][0] if len(best) == k else 1
                for i in np.flatnonzero(scores >= max(low, 1)).tolist():
                    offer(int(scores[i]), int(self.ids[docs[i]]))
                continue
            t = int((weights * (top >> _PLACE_BITS)).argmax())
            doc = int(self.keys[self.mask - (int(top[t]) & self.mask)] - base[t])
            at = np.clip(np.searchsorted(self.keys, base + doc), a, b)
            has = (at < b) & (self.keys[np.minimum(at, len(self.keys) - 1)] == base + doc)
            offer(int((weights[has] * self.impact[at[has]]).sum()), int(self.ids[doc]))
            scored += 1
            push(a, at)
            push(at + has, b)
        return scored


_FOUND = "item long, doc_id long, score long, scored long"
ITEM, DOCS, LIST = 0, 1, 2


def _search(k: int, leaf: int, n_docs: int, n_terms: int):
    """Rows sorted by (lane, block, shard, kind): a lane's items, then its shards, documents before
    lists.  Yields the best k of each item, and once a lane the number of documents scored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, shard, docs, lists, names = None, None, None, [], {}
        items: list[tuple] = []
        scored = 0

        def search_shard():
            nonlocal scored
            if not lists:
                return
            s = Shard(*docs, lists, n_docs, n_terms)
            for _, terms, best in items:
                own = [(names[t], w) for t, w in terms if t in names]
                if own:
                    scored += s.search(*(np.array(x, np.int64) for x in zip(*own)), best, k, leaf)

        def results() -> pa.RecordBatch:
            out = [(item, -d, s, None) for item, _, best in items for s, d in best]
            out.append((None, None, None, scored))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                              names=["item", "doc_id", "score", "scored"])

        for batch in batches:
            for *place, kind, own, item, terms, term, ids, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if place != lane or own != shard:
                    search_shard()
                    shard, docs, lists, names = own, None, [], {}
                if place != lane:
                    if lane is not None:
                        yield results()
                    lane, items, scored = place, [], 0
                if kind == ITEM:
                    items.append((item, [(t["term"], t["weight"]) for t in terms], []))
                elif kind == DOCS:
                    docs = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32)
                else:
                    names[term] = len(lists)
                    lists.append((np.frombuffer(ids, np.int32), np.frombuffer(counts, np.int32)))
        search_shard()
        if lane is not None:
            yield results()
    return run


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(item, t.decode(), n) for item, text in zip(*(c.to_pylist() for c in batch.columns))
                for t, n in Counter(terms_of(text)).items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.string(), pa.int64()))], names=["item", "term", "times"])


def rank(docs: DataFrame, items: DataFrame, k: int = K, shard_terms: int = SHARD_TERMS,
         lane_postings: int = LANE_POSTINGS, block_items: int = BLOCK_ITEMS, leaf: int = LEAF) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item (item_id, text)."""
    return _ranked(_searched(docs, items, k, shard_terms, lane_postings, block_items, leaf), k)


def _searched(docs: DataFrame, items: DataFrame, k: int, shard_terms: int, lane_postings: int,
              block_items: int, leaf: int) -> DataFrame:
    """The best k of every lane, and rows with the number of documents scored in it."""
    shards = index(docs, shard_terms)
    asked = written(items.select(F.col("item_id").cast("long").alias("item"), "text")
                    .mapInArrow(_count_terms, "item long, term string, times long")
                    .groupBy("item", "term").agg(F.sum("times").alias("times")), "asked")
    total = shards.where("term is null").select(F.col("n"), F.col("shard")).agg(F.sum("n").alias("docs")).first()["docs"] or 0
    words = (shards.where("term is null").select("counts").mapInArrow(_sums, "n long").agg(F.sum("n")).first()[0]) or 0
    # lists of terms that no item asks for are not read again
    lists = shards.join(asked.select("term").distinct(), "term")
    held = written(lists.groupBy("term").agg(F.sum("n").alias("df")), "df")
    weighed = asked.join(held, "term").select("item", F.struct("term", (F.col("times") * F.floor(
        1000 * F.log((F.lit(2.0) * total + 2) / (2 * F.col("df") + 1)))).alias("weight")).alias("t"))
    per_item = weighed.groupBy("item").agg(F.collect_list("t").alias("terms"))
    blocks = max(1, -(-asked.select("item").distinct().count() // block_items))
    lanes = max(1, -(-(held.agg(F.sum("df")).first()[0] or 0) // lane_postings))
    lane = F.pmod(F.xxhash64("shard"), F.lit(lanes))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    none = F.lit(None)
    per_lane = per_item.select(numbers(lanes).alias("lane"), F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"),
                               F.lit(-1).cast("long").alias("shard"), F.lit(ITEM).alias("kind"), "item", "terms",
                               none.cast("string").alias("term"), none.cast("binary").alias("ids"),
                               none.cast("binary").alias("counts"))
    kept = shards.where("term is null").select("shard", "term", "ids", "counts", F.lit(DOCS).alias("kind")).unionByName(
        lists.select("shard", "term", "ids", "counts", F.lit(LIST).alias("kind")))
    kept = kept.select(lane.alias("lane"), numbers(blocks).alias("block"), "shard", "kind", none.cast("long").alias("item"),
                       none.cast(per_lane.schema["terms"].dataType).alias("terms"), "term", "ids", "counts")
    order = ["lane", "block", "shard", "kind"]
    rows = (per_lane.unionByName(kept).repartition("lane", "block").sortWithinPartitions(*order)
            .select("lane", "block", "kind", "shard", "item", "terms", "term", "ids", "counts"))
    return written(rows.mapInArrow(_search(k, leaf, int(total), int(words)), _FOUND), "found")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return (found.where("score is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select(F.col("item").alias("item_id"), "rank",
                    F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "score"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(c, np.int32).sum(dtype=np.int64))
                                                    for c in batch.column(0).to_pylist()], pa.int64())], names=["n"])


_SQL_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS t FROM documents),
doc AS (SELECT r, doc_id, len(t)::BIGINT AS n, t FROM d WHERE len(t) > 0),
g AS (SELECT count(*)::BIGINT AS N, sum(n)::BIGINT AS L FROM doc),
post AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM doc) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * g.N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM post, g GROUP BY term, g.N),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
s AS (SELECT q.item_id, post.r, sum(q.times * w.w * ((1000000000 * post.tf) // (1000 * post.tf + 12 * (100 - 25 + ((25 * doc.n * g.N) // g.L)))))::BIGINT AS score
      FROM q JOIN w ON q.term = w.term JOIN post ON post.term = q.term JOIN doc ON doc.r = post.r, g GROUP BY q.item_id, post.r)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT s.item_id, doc.doc_id, s.score, row_number() OVER (PARTITION BY s.item_id ORDER BY s.score DESC, doc.doc_id NULLS LAST) AS rank
  FROM s JOIN doc ON s.r = doc.r WHERE s.score > 0) WHERE rank <= 20
"""
