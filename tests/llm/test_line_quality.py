import re

from llm.helpers import DOCS, docs_of, same_as_oracle, word_soup

from tillcycle.llm import line_quality as lq

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    repeated = {j for ps in at.values() if len(ps) > 1 for p in ps for j in (p, p + 1, p + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(repeated), n < 50 or 100 * len(repeated) > 50 * n)


def test_base_counts(spark):
    texts = [None, "", " \n\t", "a b c a b c a b c", "é ü 😀|<x>", "x y z", "l\nl\n L\n\nl", "a a a a a",
             *[word_soup(i, 300, 12) for i in range(6)], word_soup(9, 5000, 40), word_soup(1, 60) + "\n" * 3]
    got = {r["doc_id"]: tuple(r)[2:8] for r in lq.base_rules(docs_of(spark, texts)).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def plain_verdicts(rows, min_docs, share, pct):
    docs = list(dict.fromkeys((i, s, t) for i, t, s in rows))
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held, host = {}, {}
    for i, s, t in docs:
        host[s] = host.get(s, 0) + 1
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            held.setdefault((s, k), []).append(i)
    often = {k: min(ids) for k, ids in held.items() if len(ids) > min_docs and len(ids) > share * host[k[0]]}
    out = {}
    for i, s, t in docs:
        gone = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if often.get((s, key(x)), i) != i)
        b = base(t)
        out[i] = (b[0] - gone, not b[5] and (b[0] - gone) * 100 >= b[0] * pct)
    return out


def test_frequent_lines_and_depleted_documents(spark):
    common, mark = word_soup(1, 70, 900), "Shared line HERE"
    texts = [common if i % 3 == 0 else f"{word_soup(100 + i, 80, 900)}\n{mark}  \n{mark.lower()}" for i in range(40)]
    sources = ["a" if i % 4 else None for i in range(40)]
    rows = [(i, t, s) for i, (t, s) in enumerate(zip(texts, sources))]
    df = docs_of(spark, texts, sources)
    want = plain_verdicts(rows, 2, 0.1, 30)
    for frame in (df, df.union(df)):  # repeated rows are one document
        got = {r["doc_id"]: (r["words_left"], r["kept"])
               for r in lq.judge(frame, min_docs=2, share=0.1).distinct().collect()}
        assert got == want
    assert {k for _, k in want.values()} == {True, False}
    kept = {r["doc_id"]: r for r in lq.clean(df, min_docs=2, share=0.1).collect()}
    assert set(kept) == {i for i, (_, k) in want.items() if k}
    assert sum(mark in r["text"] for r in kept.values()) == 2  # one document of each host keeps it
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())


def test_empty_and_query(spark):
    empty = spark.createDataFrame([], DOCS)
    assert lq.judge(empty).count() == 0 and lq.clean(empty).count() == 0
    same_as_oracle(spark, "op2_line_quality")
