import re

import numpy as np
from llm.helpers import DOCS, docs_of, same_as_oracle, word_soup

from tillcycle.llm import line_dedup as ld
from tillcycle.llm.cuckoo import CuckooFilter


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(1)
    k1, k2 = rng.integers(-2**62, 2**62, (2, 5000))
    f = CuckooFilter.built(k1[:4000], k2[:4000])
    assert f.contains(k1[:4000], k2[:4000]).all() and f.contains(k1[4000:], k2[4000:]).mean() < 0.01
    f = CuckooFilter.loads(f.dumps())
    f.delete(k1[:1000], k2[:1000])
    assert f.contains(k1[1000:4000], k2[1000:4000]).all() and f.contains(k1[:1000], k2[:1000]).mean() < 0.01
    full = CuckooFilter.sized(8)
    while full.add(*rng.integers(0, 2**62, (2, 1))):
        pass  # a full filter says so


def plain(rows, min_docs=3, min_chars=20):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def result(df):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"] or "") for r in df.collect()}


def test_lines_of_three_documents(spark):
    a, b, exact = "A line that is shared BY many", "É" * 20, "x" * 19
    texts = [None, "", "\n\n", f"{a}\nown 1\n{a.lower()} \t", f" {a}\n{b}\n{exact}", f"{a.upper()}\n{b}\n{exact}",
             f"{b}\nlast\n{exact}", f"{a} \n{a}", f"{a}", *[word_soup(i % 4, 30) for i in range(9)], "y" * 100_000]
    df = docs_of(spark, texts).withColumn("n_lines", ld.F.lit("clash")).withColumn("drop", ld.F.lit(1))
    assert result(ld.dedup(df)) == plain(list(enumerate(texts)))


def test_delete_undoes_insert(spark):
    old = docs_of(spark, [f"{word_soup(i % 7, 20)}\n{word_soup(50 + i % 3, 20)}" for i in range(30)])
    new = docs_of(spark, [f"{word_soup(i % 5, 20)}\n{word_soup(70 + i, 20)}" for i in range(20)],
                  ids=list(range(100, 120)))
    both = old.unionByName(new)
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    state = ld.LineDedup(spark, shards=3).insert(old)
    refs = lambda: {tuple(r) for r in state.refs.collect()}
    before = refs()
    assert result(state.clean(old)) == plain(rows(old))
    state.insert(new)
    assert refs() != before and result(state.clean(both)) == plain(rows(both))
    state.insert(spark.createDataFrame([], DOCS))
    state.delete(new.select("doc_id"))
    assert refs() == before and result(state.clean(old)) == plain(rows(old))
    keys = {(r["shard"], r["k1"], r["k2"]) for r in state.refs.collect()}
    filters = {r["shard"]: CuckooFilter.loads(bytes(r["filter"])) for r in state.filters.collect()}
    assert all(filters[s].contains(np.array([a]), np.array([b]))[0] for s, a, b in keys)
    assert sum(int((f.slots != 0).sum()) for f in filters.values()) == len(keys)  # nothing of the others is left
    part = old.where("doc_id >= 10")  # the keeper becomes the next largest id
    state.delete(part.select("doc_id"))
    rest = old.where("doc_id < 10")
    assert result(state.clean(rest)) == plain(rows(rest))


def test_repeated_rows_empty_and_query(spark):
    line = "the same long line in all"
    rows = [(1, line), (1, line), (None, line), (2, "x")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    assert {r["n_dropped"] for r in ld.dedup(df).collect()} == {0}  # two documents hold it
    assert sum(r["n_dropped"] for r in ld.dedup(df.unionByName(docs_of(spark, [line], ids=[9]))).collect()) == 3
    assert ld.dedup(spark.createDataFrame([], DOCS)).count() == 0
    same_as_oracle(spark, "op4_line_dedup")


def test_a_small_batch_reads_only_its_shards_and_the_keys_that_may_be_known(spark, tmp_path):
    texts = [f"{word_soup(i, 20)}\n{word_soup(1000 + i % 11, 20)}" for i in range(24)]
    old, path = docs_of(spark, texts), str(tmp_path / "lines")
    ld.LineDedup(spark, path, shards=12).insert(old, batch="first")
    state = ld.LineDedup(spark, path)  # as a new session opens it
    assert state.shards == 12 and state.insert(old, batch="first").made["generation"] == 1
    known, fresh = word_soup(1000, 20), word_soup(5000, 20)
    seen = []
    read = state._read
    state._read = lambda kind, touched=None: seen.append((kind, touched)) or read(kind, touched)
    new = docs_of(spark, [f"{known}\n{fresh}"], ids=[900])
    state.insert(new)
    k = [int(np.frombuffer(ld.line_key(x, 20), "<i8")[0] % 12) for x in (known, fresh)]
    assert seen[0] == ("filters", sorted(set(k))) and seen[1] == ("refs", [k[0]])  # the fresh key asks for no counts
    plan = read("refs", [k[0]])._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^]]*shard#\d+ (= {k[0]}|IN \({k[0]}\))", plan), plan
    newest = state.made["folders"]["refs"][-1][1]
    assert spark.read.parquet(f"{path}/{newest}/refs").count() == 2  # only what the batch touched is written
    again = ld.LineDedup(spark, path)
    both = old.unionByName(new)
    want = plain([(r["doc_id"], r["text"]) for r in both.collect()])
    assert result(again.clean(both)) == want
    refs = {tuple(r)[1:] for r in again.refs.collect()}
    again.compact(shards=7)
    assert again.shards == 7 and {tuple(r)[1:] for r in again.refs.collect()} == refs
    assert result(ld.LineDedup(spark, path).clean(both)) == want
    again.delete(spark.createDataFrame([(900,), (31337,), (None,)], "doc_id long"))
    assert result(again.clean(old)) == plain(list(enumerate(texts)))
    again.insert(new)  # back again after its deletion
    assert result(ld.LineDedup(spark, path).clean(both)) == want


def test_shards_grow_and_a_failed_change_leaves_the_state(spark, tmp_path):
    path = str(tmp_path / "lines")
    docs = lambda a, n: docs_of(spark, [word_soup(i, 20) for i in range(a, a + n)], ids=list(range(a, a + n)))
    state = ld.LineDedup(spark, path, keys_per_shard=4).insert(docs(0, 4))
    assert state.shards == 8
    state.insert(docs(4, 60))
    assert state.shards == 64 and state.made["keys"] == 64
    broken = docs(100, 3).withColumn("text", ld.F.raise_error(ld.F.lit("lost")).cast("string"))
    try:
        state.insert(broken)
    except Exception:  # noqa: BLE001, S110
        pass
    after = ld.LineDedup(spark, path, keys_per_shard=4)
    assert after.refs.count() == 64 and after.made == state.made
    held = {r["shard"]: r["filter"] for r in after.filters.collect()}
    keys = [(r["shard"], r["k1"], r["k2"]) for r in after.refs.collect()]
    assert all(CuckooFilter.loads(bytes(held[s])).contains(np.array([a]), np.array([b]))[0] for s, a, b in keys)


def test_a_shard_without_a_filter_is_looked_up(spark, monkeypatch):
    monkeypatch.setattr(CuckooFilter, "add", lambda self, k1, k2: False)
    a, b = docs_of(spark, [word_soup(1, 20)] * 2), docs_of(spark, [word_soup(1, 20)] * 2, ids=[7, 8])
    out = ld._refilter(10)
    import pyarrow as pa
    none = pa.table({"filter": pa.array([], pa.binary())})
    change = pa.table({"k1": [5], "k2": [6], "step": [1]})
    got = out((pa.scalar(3),), change, none)
    assert got["filter"].to_pylist() == [None] and got["shard"].to_pylist() == [3]
    assert ld._ask(change, got)["maybe"].to_pylist() == [True]
    monkeypatch.undo()
    state = ld.LineDedup(spark, shards=2).insert(a).insert(b)
    assert [(r["refs"], r["keeper"]) for r in state.refs.collect()] == [(4, 8)]
