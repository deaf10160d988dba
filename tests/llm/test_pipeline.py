import corpus_pipeline as cp
from llm.helpers import DOCS, SF_SMALL, docs_of, word_soup
from llm.test_line_dedup import plain as plain_lines
from llm.test_line_quality import plain_verdicts
from llm.test_packing import held_right, plain_ids
from llm.test_simhash import plain_components, plain_fingerprint

from tillcycle.llm.common import written
from tillcycle.llm.source_mix import mix


def test_each_stage_against_a_plain_version(spark):
    copied, boiler = word_soup(1, 200, 5000), word_soup(2, 8, 5000)
    texts = [f"{word_soup(50 + i, 80, 5000)}\n{boiler}\n{word_soup(300 + i % 40, 12, 5000)}" for i in range(60)]
    texts += [copied, copied.upper(), copied.replace(" ", "\t"), None, "", "too short", f"{boiler}\n{boiler}"]
    texts += [word_soup(900 + i, 300, 5000) for i in range(20)]
    docs = docs_of(spark, texts, [["a", "b", None][i % 3] for i in range(len(texts))]).cache()
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_dedup", "source_mix", "packing"]
    seen = {}
    df = docs
    for name, stage in cp.STAGES:
        before = df
        df = written(stage(spark, df, None), name)
        seen[name] = (before, df)
        if name != "packing":
            assert df.dtypes == docs.dtypes
    rows = lambda d: [(r["doc_id"], r["text"]) for r in d.collect()]

    before, after = seen["quality_rules"]
    want = plain_verdicts([(r["doc_id"], r["text"], r["source"]) for r in before.collect()], 10, 0.005, 30)
    assert sorted(i for i, _ in rows(after)) == sorted(i for i, (_, kept) in want.items() if kept)
    assert sum(boiler in t for _, t in rows(after)) == 3  # once a host

    before, after = seen["line_dedup"]
    want = plain_lines(rows(before))
    assert {i: t for i, t in rows(after)} == {i: w[2] for i, w in want.items()}
    assert any(w[1] for w in want.values())
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())

    before, after = seen["simhash_dedup"]
    own = rows(before)
    roots = plain_components([plain_fingerprint(t) for _, t in sorted(own)])
    ids = sorted(i for i, _ in own)
    assert sorted(i for i, _ in rows(after)) == sorted({ids[r] for r in roots})
    assert len(roots) > len(set(roots))

    before, after = seen["source_mix"]
    copies = {r["doc_id"]: r["copies"] for r in mix(before).collect()}
    got = [i for i, _ in rows(after)]
    assert {i: got.count(i) for i in copies} == copies and 2 in copies.values()

    before, after = seen["packing"]
    assert after.agg({"length": "sum"}).first()[0] == sum(map(len, plain_ids([t for _, t in rows(before)])))


def test_run_and_empty_input(spark):
    assert cp.ORACLE_SQL is None
    assert cp.run(spark, SF_SMALL).count() > 100
    df = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        df = stage(spark, df, None)
    assert df.count() == 0


def test_one_copy_of_each_packs_right(spark):
    docs = docs_of(spark, [word_soup(i, 40 + i) for i in range(30)])
    ids = dict(enumerate(plain_ids([r["text"] for r in docs.orderBy("doc_id").collect()])))
    assert held_right(cp.pack_documents(spark, docs, None).collect(), ids, 1024) < 1024


#: Names that stages or their operators use, or used, for columns of their own.
HELPERS = """kept_text n_lines n_dropped drop doc own_id own_drop __doc __drop __own __id __gone __body gone_at own own_body body host
    keeper h n_docs words words_left kept row1 row2 row1_ __row1 __row2 copies copies_of turn __copies __i size sk bucket target
    taken source_size fp root first cell component_id anchor row spans n_words base_failed a.b c`d N_Lines""".split()


def test_columns_of_any_name_pass_every_stage_unchanged(spark):
    boiler = word_soup(2, 8, 5000)
    texts = [f"{word_soup(50 + i, 80, 5000)}\n{boiler}\n{word_soup(300 + i % 5, 12, 5000)}" for i in range(30)]
    texts += [texts[0], word_soup(3, 70000, 60000), None]
    F = cp.F
    plain = docs_of(spark, texts, [["a", None][i % 2] for i in range(len(texts))])
    names = list(dict.fromkeys(n for n in HELPERS))
    names = [n for i, n in enumerate(names) if n.lower() not in {m.lower() for m in names[:i]}]
    docs = plain.select("*", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in names],
                        F.create_map(F.lit("k"), F.col("doc_id")).alias("tags"), F.array("source").alias("list"))
    docs, plain = written(docs, "docs"), written(plain, "plain")
    for name, stage in cp.STAGES[:-1]:
        out, want = stage(spark, docs, None), stage(spark, plain, None)
        assert out.dtypes == docs.dtypes, name
        rows = [r.asDict() for r in out.collect()]
        for r in rows:
            assert all(r[n] == f"{n}:{r['doc_id']}" for n in names) and r["tags"] == {"k": r["doc_id"]}, name
        key = lambda r: (r["doc_id"], r["text"] or "", r["n_chars"] or 0)
        assert sorted(map(key, rows)) == sorted(key(r.asDict()) for r in want.collect()), name
    assert cp.pack_documents(spark, docs, None).count() == cp.pack_documents(spark, plain, None).count()


def test_rows_without_id_or_with_one_id(spark):
    texts = [word_soup(i, 90, 5000) for i in range(12)]
    docs = written(docs_of(spark, texts, ids=[None] * 4 + [7] * 4 + [1, 2, 3, 4]), "docs")
    for name, stage in cp.STAGES[:-1]:
        got = sorted({r["text"] for r in stage(spark, docs, None).collect()})
        assert got == sorted(texts), name
