import random

import numpy as np
import xxhash
from llm.helpers import DOCS, SF_SMALL, docs_of, word_soup

from tillcycle.llm import simhash_dedup as sd
from tillcycle.llm.queries import QUERIES


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components(spark):
    base = word_soup(5, 400, 3000)
    near = [" ".join(w if (i * 7 + k) % 150 else f"x{k}" for i, w in enumerate(base.split())) for k in range(30)]
    texts = [None, "", " \n", "one", "ONE", "one two three", "É é", base, base.upper(), base.replace(" ", "\n"),
             *near, *[word_soup(i, 50) for i in range(20)]]
    rows = sd.near_duplicates(docs_of(spark, texts)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in rows} == dict(enumerate(fps))
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(plain_components(fps)))
    kept = {r["doc_id"] for r in sd.keep_first(docs_of(spark, texts)).collect()}
    assert kept == set(plain_components(fps))


def test_cells_hold_every_pair_within_four_bits():
    rnd = random.Random(2)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, 4)):
            b ^= 1 << bit
        cell, at = sd.cells_of(np.array([a, b], np.uint64))
        assert set(cell[at == 0]) & set(cell[at == 1])


def test_chains_and_large_cells(spark):
    rnd = random.Random(4)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for start in (0, (1 << 64) - 1, 0x5555555555555555):  # chains and dense groups
        x = start
        for _ in range(60):
            fps.append(x)
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5)))
    fps += [fps[-1] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    fps = sorted(set(fps))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    want = plain_components(fps)
    for most in (10, 20_000):
        roots = {r["node"]: r["root"] for r in sd.components(sd.links(df, 4, most)).collect()}
        got = [roots.get(f, f) for f, in signed]
        assert {tuple(np.flatnonzero(np.array(got) == r)) for r in set(got)} == \
            {tuple(np.flatnonzero(np.array(want) == r)) for r in set(want)}


def test_empty_nulls_and_query(spark):
    assert sd.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(None, "a", None, None, None), (7, "a", None, None, None),
                                  (7, "a", None, None, None)], DOCS)
    assert {tuple(r)[::2] for r in sd.near_duplicates(rows).collect()} == {(None, 7), (7, 7)}
    assert [r["doc_id"] for r in sd.keep_first(rows).collect()] == [7]
    rows = QUERIES["op3_simhash_dedup"](spark, SF_SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{f:016x}" for i, f in fps.items()}
    ids = sorted(texts)
    want = plain_components([fps[i] for i in ids])
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: ids[w] for i, w in zip(ids, want)}


def test_keep_first_without_ids_and_with_one_id_on_two_texts(spark):
    a, b, c, d, e = (word_soup(700 + i, 120, 5000) for i in range(5))
    rows = [(None, a), (None, a.upper()), (None, b), (None, c), (5, c), (7, c), (None, d),
            (3, d), (3, e), (2, e), (3, e), (9, a + " "), (None, None), (None, ""), (8, b), (8, word_soup(9, 120, 5000))]
    docs = docs_of(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    roots = plain_components([plain_fingerprint(t) for _, t in rows])
    want = {}
    for (i, t), root in zip(rows, roots, strict=True):
        want[root] = min(want.get(root, (True, 0)), (i is None, i or 0))
    got = [(r["doc_id"] is None, r["doc_id"] or 0) for r in sd.keep_first(docs).collect()]
    assert sorted(got) == sorted(want.values()) == [(False, 2), (False, 3), (False, 5), (False, 8), (False, 8),
                                                    (False, 9), (True, 0)]
    kept = {(r["doc_id"], r["text"]) for r in sd.keep_first(docs).collect()}
    assert {(2, e), (3, d), (5, c), (8, b), (9, a + " ")} <= kept and (3, e) not in kept
    lone = [word_soup(800 + i, 120, 5000) for i in range(6)]
    for part in (1, 5):  # all without id, whatever the order and the partitions
        df = docs_of(spark, [*lone, lone[0].upper(), lone[1]], ids=[None] * 8).repartition(part)
        kept = [r["text"] for r in sd.keep_first(df).collect()]
        assert sorted(t.lower() for t in kept) == sorted(lone)
        assert part == 1 or set(kept) == before
        before = set(kept)
    swapped = spark.createDataFrame([(None, "t u v w", "x", None, 7), (None, "t u v w", None, "x", 7)], DOCS)
    assert len({(r[0], r[1]) for r in swapped.select(*sd.row_hashes(swapped)).collect()}) == 2
