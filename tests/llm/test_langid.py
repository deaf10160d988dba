import zlib

import numpy as np
from llm.helpers import DOCS, SF_MID, SF_SMALL, docs_of

from tillcycle.llm import crf, langid


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    emit, step, start = rng.random((4, 3)).astype("float32"), rng.random((3, 3)), rng.random(3)
    paths = np.indices((3,) * 4).reshape(4, -1).T
    p = np.array([start[y[0]] * np.prod(emit[range(4), y]) * np.prod(step[y[:-1], y[1:]]) for y in paths])
    want = np.array([[p[paths[:, t] == k].sum() for k in range(3)] for t in range(4)]) / p.sum()
    for texts in ([emit], [emit, emit[:2]]):
        x, active = crf.stacked(texts)
        a, b, _ = crf.forward_backward(x, active, step, start)
        g = (a * b)[:, 0]
        assert np.allclose(g / g.sum(1, keepdims=True), want, atol=1e-5)


def test_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert len(right) > 200 and sum(right) / len(right) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_code_switched_texts_nulls_and_marks(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").drop("n_chars")
    rows = {lang: docs.where(f"lang = '{lang}' and length(text) > 600").first()["text"] for lang in ("en", "de")}
    half = " ".join(rows["en"].split()[:60]) + " " + " ".join(rows["de"].split()[:40])
    texts = [None, "", "123 ... _ ½", half, "x" * 200_000, half.upper()]
    model = langid.fit(docs)
    frame = docs_of(spark, texts).withColumn("score", langid.F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.predict(frame.union(frame), model).collect()}
    assert [(got[i]["lang_pred"], got[i]["score"], got[i]["runs"]) for i in range(3)] == [("und", 0.0, [])] * 3
    assert got[3]["lang_pred"] == got[5]["lang_pred"] == "en" and 0.4 < got[3]["score"] < 0.8
    assert [r["lang"] for r in got[3]["runs"] if r["words"] > 20] == ["en", "de"]
    assert sum(r["words"] for r in got[3]["runs"]) == len(crf.words_of(half))


def test_no_labels_and_empty(spark):
    rows = langid.identify(docs_of(spark, ["a b", None], langs=[None, None])).collect()
    assert [r["lang_pred"] for r in rows] == ["und", "und"]
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0


def test_no_language_is_left_out_and_the_sample_is_bounded(spark):
    rng = np.random.default_rng(7)
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x3B1, 0x3C9)] + [chr(c) for c in range(0x430, 0x450)]
    texts, langs = [], []
    for i in range(70):
        own = [letters[j] for j in rng.permutation(len(letters))[:4]]
        words = ["".join(own[j] for j in rng.integers(0, 4, 5)) for _ in range(12)]
        texts += [" ".join(words[j] for j in rng.integers(0, 12, 40)) for _ in range(6)]
        langs += [f"l{i:02}"] * 6
    texts[5] += " " + "y" * 100_000   # a word too long to learn from
    docs = docs_of(spark, texts, langs=langs)
    rows = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    right = [rows[i]["lang_pred"] == lang for i, lang in enumerate(langs)]
    assert {r["lang_pred"] for r in rows.values()} == set(langs) and sum(right) / len(right) > 0.97
    few = langid.sample(docs, all_chunks=70)
    assert sorted(lang for _, lang in few) == sorted(set(langs)) and max(len(w) for w, _ in few) <= langid.CHUNK
    assert max(len(w) for words, _ in langid.sample(docs) for w in words) <= langid.LONGEST
    long = docs_of(spark, [" ".join(["ab cd"] * 5000), "ef gh"], langs=["x", "y"])
    assert len(langid.sample(long, per_lang_chunks=7)) <= 8
