import math
import random
import re
from collections import Counter

import numpy as np
from llm.helpers import DOCS, SF_SMALL, docs_of, same_as_oracle, word_soup

from tillcycle.llm import rmq_search
from tillcycle.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows, items, k=20):
    """All documents scored: {item_id: [(doc_id, score)]}."""
    docs = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = {}
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(TERM.findall((text or "").translate(LOWER)))
    for item, terms in asked.items():
        scores = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in terms.items() if t in c)
            if s > 0:
                scores.append((-s, math.inf if i is None else i))
        out[item] = [(None if i == math.inf else i, -s) for s, i in sorted(scores)[:k]]
    return {i: r for i, r in out.items() if r}


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r["item_id"]), r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def test_terms():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choice("aZ09 _-\n\x00\x7f\x80\x85\xa0éÉß×漢 .") for _ in range(40))
        assert [t.decode() for t in rmq_search.terms_of(text)] == TERM.findall(text.translate(LOWER))


def test_range_maxima():
    rnd = np.random.default_rng(3)
    lists = [(np.sort(rnd.choice(500, n, replace=False)).astype(np.int32), rnd.integers(1, 9, n).astype(np.int32))
             for n in (1, 2, 37, 256, 499)]
    s = rmq_search.Shard(np.arange(500), rnd.integers(1, 900, 500).astype(np.int32), lists, 500, 90_000)
    for _ in range(300):
        t = int(rnd.integers(5))
        a, b = np.sort(rnd.integers(s.starts[t], s.ends[t] + 1, 2))
        top = int(s.maxima(np.array([a]), np.array([b]))[0])
        own = s.impact[a:b]
        assert top >> 40 == (own.max() if len(own) else 0)
        if len(own):
            assert s.mask - (top & s.mask) == a + int(own.argmax())


def corpus():
    rnd = random.Random(5)
    rows = [(50_000, None), (50_001, ""), (50_002, "... --- !!!"), (None, word_soup(1, 40, 30)), (None, "W1 w2"),
            (7, word_soup(2, 60, 30)), (7, word_soup(2, 60, 30)), (50_003, "É é ß 漢 漢字 w1_w2-w3")]
    copy = word_soup(8, 50, 40)
    rows += [(rnd.randrange(100_000), copy) for _ in range(60)]
    rows += [(i, word_soup(100 + i, rnd.randint(1, 120), rnd.choice([10, 40, 400]))) for i in range(300)]
    rows.append((60_000, word_soup(9, 30_000, 400)))
    items = [(1, copy), (2, word_soup(2, 10, 30)), (3, None), (4, "nothing of it"), (5, "w1 w1 w1 w2"), (6, "漢字 É"),
             (5, "w3"), (None, "w1 w9"), (8, word_soup(9, 500, 400))]
    return rows, items


def test_against_all_scores(spark):
    rows, items = corpus()
    df = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in rows], DOCS).withColumnRenamed("lang", "term")
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("shard", rmq_search.F.lit("x"))
    for kw in ({}, {"shard_terms": 500, "lane_postings": 700, "block_items": 2, "leaf": 1}, {"k": 3, "leaf": 8, "shard_terms": 4000}):
        assert ranked(rmq_search.rank(df, asked, **kw)) == plain(rows, items, kw.get("k", 20))


def test_intervals_out_of_reach_are_dropped(spark):
    """Most documents that share a word with an item are never scored."""
    texts = [word_soup(i, 60, 2000) for i in range(3000)] + [word_soup(5000 + i % 3, 60, 2000) for i in range(60)]
    docs = docs_of(spark, texts).coalesce(1)
    items = [(i, word_soup(5000 + i, 60, 2000)) for i in range(3)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = rmq_search._searched(docs, asked, 20, 1 << 20, 1 << 20, 4096, 16)
    assert ranked(rmq_search._ranked(found, 20)) == plain(list(enumerate(texts)), items)
    sharing = sum(1 for t in texts for _, q in items if set(t.split()) & set(q.split()))
    scored = found.agg(rmq_search.F.sum("scored")).first()[0]
    assert sharing > 5000 and scored < sharing // 4


def test_empty_tables(spark):
    items = table(spark, SF_SMALL, "benchmark")
    assert rmq_search.rank(spark.createDataFrame([], DOCS), items).count() == 0
    assert rmq_search.rank(docs_of(spark, ["w1"]), items.limit(0)).count() == 0


def test_query(spark):
    same_as_oracle(spark, "op12_rmq_search")
