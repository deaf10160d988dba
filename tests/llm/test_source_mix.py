from llm.helpers import DOCS, SF_SMALL, docs_of, same_as_oracle, word_soup

from tillcycle.llm import source_mix as sm


def plain_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * w[s] / rest >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else left * w[s] / rest for s in names}
        full |= over


def test_targets_takes_and_reruns(spark):
    texts = [None, "", *[word_soup(i, 1 + i * i % 97) for i in range(600)]]
    sources = [["a", "b", "é", "Z", None, "b", "b", "b"][i % 8] for i in range(len(texts))]
    df = docs_of(spark, texts, sources).withColumn("size", sm.F.lit("clash")).withColumn("k", sm.F.lit(1))
    rows = sm.mix(df).collect()
    sizes = {s: sum(len((t or "").split()) for t, x in zip(texts, sources) if x == s) for s in set(sources)}
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 for r in own)
        assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2 for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 0.02 * want[s] + 97
    assert {tuple(r) for r in sm.mix(df.repartition(7)).collect()} == {tuple(r) for r in rows}
    mixed = sm.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in rows)


def test_repeated_rows_empty_and_one_source(spark):
    df = docs_of(spark, ["a b c"] * 10, ids=[1] * 10)
    rows = sm.mix(df).collect()
    assert sum(r["copies"] for r in rows) == 15 and {r["target"] for r in rows} == {45.0}
    assert sm.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert {r["taken"] for r in sm.mix(docs_of(spark, [None, ""])).collect()} == {0}


def test_query(spark):
    same_as_oracle(spark, "op10_source_mix")
    assert sm.mix(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).count() == 200


def test_repeated_and_null_ids_get_their_own_copies(spark):
    texts = [word_soup(i, 1 + i * i % 97) for i in range(300)] + ["x y z"] * 6
    sources = ["abc"[i % 3] for i in range(300)] + ["a"] * 6
    ids = [None if i % 3 == 1 or i % 5 == 0 else i // 4 for i in range(300)] + [None] * 6
    df = docs_of(spark, texts, sources, ids=ids)
    got, want = {}, plain_targets({s: sum(len(t.split()) for t, x in zip(texts, sources) if x == s) for s in "abc"})
    rows = sm.mixed_documents(df).collect()
    for r in rows:
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    assert all(abs(got[s] - want[s]) <= 0.02 * want[s] + 97 for s in "abc")
    assert len(rows) == sum(r["copies"] for r in sm.mix(df).collect())
    assert all(sum(r["text"] == t for r in rows) <= 2 * texts.count(t) for t in set(texts))
