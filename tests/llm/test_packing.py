import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from llm.helpers import DOCS, SF_SMALL, docs_of, word_soup

from tillcycle.llm import packing
from tillcycle.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(texts):
    from tokenizers import Tokenizer
    return [e.ids + [0] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts],
                                                                       add_special_tokens=False)]


def held_right(rows, ids, window):
    """Every id in exactly one piece, checksums, gapless sequences; returns the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            part = ids[d][at:at + p["length"]]
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[d])
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[d])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += window - at
    return padding


def test_encoder_gives_the_tokenizer_s_ids():
    rnd = random.Random(1)
    pool = [chr(c) for c in range(0x250)] + list(" \n\t\r \x0b\x0c\x1c\x85\xa0") * 20 + [
        "'s", "'ll", "<|endoftext|>", "can't", "12", "abc", "the", "中", "😀", "Ж"] * 10
    encode = packing.encoder(PATH)
    assert encode.fast
    texts = ["".join(rnd.choices(pool, k=rnd.randint(0, 40))) for _ in range(3000)]
    for t, want in zip(texts, plain_ids(texts)):
        assert encode(t).tolist() == want[:-1]


def test_pieces(spark):
    texts = [None, "", "a", *[word_soup(i, random.Random(i).randint(1, 900)) for i in range(120)], "word " * 5000,
             *["same text here"] * 40]
    ids = dict(enumerate(plain_ids(texts)))
    df = docs_of(spark, texts).withColumn("length", packing.F.lit(1)).withColumn("bucket", packing.F.lit(1))
    for window in (64, 1024):
        rows = packing.pack(df, window=window).collect()
        assert held_right(rows, ids, window) < window  # at most one sequence isn't full
    again = packing.pack(df.repartition(5), window=64).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in packing.pack(df, window=64).collect()}


def test_plan_uses_patterns():
    way = packing.plan({600: 50, 424: 50, 300: 10, 1023: 4}, 1024)
    assert way["chain_from"] >= 45 and way["chain"].get(600, (50, 0))[0] >= 45 and way["chain"][1023][0] == 0
    assert way["full_from"] > way["chain_from"]
    cols, h = np.array([[1, 3, 0], [2, 2, 0]]), np.array([0.0, 5, 8, 5])
    assert np.allclose(packing.nnls(cols, h, np.zeros(2), 500), [5, 4], atol=1e-2)


def test_repeated_rows_empty_and_query(spark):
    df = docs_of(spark, ["some text", "more"])
    rows = packing.pack(df.union(df)).collect()
    assert sorted(r["offset"] for r in rows if r["sequence_id"] == rows[0]["sequence_id"])[0] == 0
    assert len(rows) >= 4
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    ids = dict(zip(texts, plain_ids(list(texts.values()))))
    assert held_right(QUERIES["op5_packing"](spark, SF_SMALL).collect(), ids, 1024) < 1024
