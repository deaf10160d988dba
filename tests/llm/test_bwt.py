import hashlib
import random
from collections import Counter

import numpy as np
from llm.helpers import DOCS, SF_SMALL, docs_of, word_soup

from tillcycle.llm import bwt_dedup
from tillcycle.llm.queries import QUERIES
from tillcycle.llm.repeats import repeated_windows, runs, seed_hashes


def plain(raws, window=400):
    count = Counter(r[i:i + window] for r in raws for i in range(len(r) - window + 1))
    out = []
    for r in raws:
        at = [i for i in range(len(r) - window + 1) if count[r[i:i + window]] > 1]
        spans = bwt_dedup.union_of(at, [window] * len(at))
        gone = set().union(*[range(a, b) for a, b in spans])
        out.append((spans, bytes(x for i, x in enumerate(r) if i not in gone)))
    return out


def test_merged_transforms_find_repeated_windows():
    rnd = random.Random(5)
    for _ in range(40):
        w = rnd.choice([8, 16, 400])
        parts = [bytes(rnd.choices(b"ab" if w < 100 else b"abcdefgh", k=rnd.randint(0, 4 * w))) for _ in range(12)]
        strings = [b"".join(rnd.choice(parts)[rnd.randint(0, w):rnd.randint(w, 3 * w)]
                            for _ in range(rnd.randint(0, 3)))[:2 * w] for _ in range(30)]
        count = Counter(s[i:i + w] for s in strings for i in range(len(s) - w + 1))
        for shard in (3 * w, 10 * w, 10**9):
            for s, got in zip(strings, repeated_windows(strings, w, shard)):
                assert got.tolist() == [count[s[i:i + w]] > 1 for i in range(max(0, len(s) - w + 1))]


def test_runs_follow_the_anchor_of_each_window():
    rnd = random.Random(6)
    for kinds in (1, 2, 26):
        data = np.array(rnd.choices(range(97, 97 + kinds), k=2000), np.uint8)
        h = seed_hashes(data) & ~np.uint64((1 << 22) - 1)
        anchors = [p + int(np.argmin(h[p:p + 273])) for p in range(1601)]
        first, last, at, _ = runs(data, 400)
        assert np.repeat(at, last - first + 1).tolist() == anchors
        assert (at[1:] != at[:-1]).all() and first[0] == 0 and last[-1] == 1600


def hostile_texts():
    rnd = random.Random(7)
    common = word_soup(1, 300)
    texts = [None, "", "short", "a" * 3000, "ab" * 900, "b" + "a" * 400, common, common, common + "!",
             "é" * 450, "x" + "é" * 450]
    for i in range(40):
        a, n = rnd.randint(0, 400), rnd.randint(300, 900)
        texts.append(word_soup(100 + i, rnd.randint(0, 90)) + common[a:a + n] + word_soup(200 + i, rnd.randint(0, 90)))
    near = word_soup(3, 400).split()
    for i in range(20):
        near[rnd.randrange(400)] = f"z{i}"
        texts.append(" ".join(near))
    return texts


def test_whole_texts_against_all_windows(spark):
    texts = hostile_texts()
    df = docs_of(spark, texts).withColumn("crc", bwt_dedup.F.lit("x")).withColumn("spans", bwt_dedup.F.lit(1))
    want = plain([(t or "").encode() for t in texts])
    for kw in ({}, {"max_group": 3000, "batch_bytes": 5000, "shard_bytes": 2000}):
        for r in bwt_dedup.remove_repeats(df, **kw).collect():
            spans, kept = want[r["doc_id"]]
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["n_bytes"], r["n_removed"], bytes(r["kept"])) == (len(raw), len(raw) - len(kept), kept)
            assert [(s["begin"], s["end"]) for s in r["spans"]] == spans


def test_a_merge_holds_a_bounded_part_of_an_anchor(spark, monkeypatch):
    rnd = random.Random(8)
    names = ["k1", "k2", "k3", "doc_id", "crc", "begin", "lead", "seen", "bytes"]

    def runs_of(anchor, n):  # runs of one anchor that share 450 bytes and differ on both sides
        same = rnd.randbytes(450)
        return [(anchor, 0, 0, i, 1, 0, 200, 0, rnd.randbytes(100) + same + rnd.randbytes(100)) for i in range(n)]

    def few(n):  # as many that share 399 bytes at most, but for pairs: nothing is trimmed away
        return [(99, 0, 0, i, 1, 0, 0, 0, a + rnd.randbytes(3)) for i in range(n // 2)
                for a in [rnd.randbytes(660)] for _ in range(2)]

    rows = [r for k in range(40) for r in runs_of(k, 150)] + few(8000)
    sizes, found = [], bwt_dedup.repeated_windows

    def watched(strings, *rest):
        sizes.append(sum(map(len, strings)))
        return found(strings, *rest)

    monkeypatch.setattr(bwt_dedup, "repeated_windows", watched)
    batch = bwt_dedup.pa.RecordBatch.from_arrays([bwt_dedup.pa.array(c) for c in zip(*rows)], names=names)
    search = bwt_dedup._search(400, bwt_dedup.SHARD_BYTES, bwt_dedup.BATCH_BYTES, bwt_dedup.MAX_GROUP, bwt_dedup.MAX_MERGE)
    out = [r for b in search(iter([batch])) for r in b.to_pylist()]
    assert sizes and max(sizes) <= bwt_dedup.MAX_MERGE
    assert [r["crc"] for r in out if r["size"] is None] == [99]
    assert sorted(r["doc_id"] for r in out if r["size"] is not None) == sorted([*range(150)] * 40)
    texts = hostile_texts()
    want = plain([(t or "").encode() for t in texts])
    for r in bwt_dedup.remove_repeats(docs_of(spark, texts), max_merge=2000).collect():
        assert bytes(r["kept"]) == want[r["doc_id"]][1]


def test_repeated_rows_nulls_and_empty(spark):
    text = word_soup(1, 200)
    rows = [(5, text), (5, text), (None, word_soup(2, 200)), (5, word_soup(3, 200))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = sorted((r["n_bytes"], r["n_removed"]) for r in bwt_dedup.remove_repeats(df).collect())
    assert got == sorted((len(t), len(t) if i == 5 and t == text else 0) for i, t in rows)
    assert bwt_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op6_bwt_dedup"](spark, SF_SMALL).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    raws = [(t or "").encode() for t in texts.values()]
    for (i, raw), (spans, kept) in zip(zip(texts, raws), plain(raws)):
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
            len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        left = kept.decode(errors="replace")
        assert (r["text"], r["n_chars"]) == (left, len(left))
