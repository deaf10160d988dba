import hashlib
import random

from llm.helpers import DOCS, docs_of, same_as_oracle, word_soup

from tillcycle.llm import automaton_dedup
from tillcycle.llm.automaton import SuffixAutomaton


def plain(rows, window):
    """(n_words, kept words) of each (doc_id, text) row."""
    last = automaton_dedup.LAST
    docs = [(last if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for doc, words in docs:
        for i in range(len(words) - window + 1):
            k = tuple(words[i:i + window])
            first[k] = min(first.get(k, last), doc)
    out = []
    for doc, words in docs:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i:i + window])] < doc:
                gone |= set(range(i, i + window))
        out.append((len(words), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return out


def test_statistics_against_all_substrings():
    rnd = random.Random(1)
    for _ in range(200):
        window = rnd.randint(1, 6)
        strings = [[rnd.choice("abc") for _ in range(rnd.randint(0, 20))] for _ in range(rnd.randint(1, 8))]
        automaton = SuffixAutomaton()
        for i, s in enumerate(strings):
            automaton.add(s, i * 7 % 8)
        automaton.close()
        for s in [*strings, [rnd.choice("abcd") for _ in range(30)]]:
            want = []
            for end in range(1, len(s) + 1):
                part = s[max(0, end - window):end]
                holders = [i * 7 % 8 for i, t in enumerate(strings)
                           if len(part) == window and any(t[k:k + window] == part for k in range(len(t)))]
                want.append(min(holders, default=None))
            assert automaton.statistics(s, window) == want


def hostile_rows():
    rnd = random.Random(3)
    common = word_soup(1, 200).split()
    rows = [(900, None), (901, ""), (902, "one two"), (903, "same " * 300), (904, "same " * 60), (905, "a b " * 100),
            (5, " ".join(common)), (5, " ".join(common)), (5, " ".join(common[:120])), (None, " ".join(common)),
            (None, " ".join(common[20:])), (906, "\t" + "\n".join(common) + " "), (-3, " ".join(common[50:140])),
            (907, "é x\xa0y " * 70), (908, " ".join(common)), (909, " ".join(common[:49])),
            (None, word_soup(77, 80)), (None, word_soup(77, 80))]
    for i in range(30):
        a = rnd.randrange(150)
        rows.append((rnd.randrange(1000), f"{word_soup(50 + i, 20)} {' '.join(common[a:a + rnd.randint(30, 90)])} tail{i}"))
    near = word_soup(9, 150).split()
    for i in range(30):
        near[rnd.randrange(150)] = f"z{i}"
        rows.append((2000 + i, " ".join(near)))
    return rows


def test_whole_texts_against_all_windows(spark):
    rows = hostile_rows()
    df = spark.createDataFrame([(i, t, str(n), "s", n) for n, (i, t) in enumerate(rows)], DOCS)
    df = df.withColumn("row", df.text).withColumn("doc", df.n_chars).withColumn("spans", df.lang)
    for window, kw in ((50, {}), (50, {"shard_words": 700}), (7, {"shard_words": 300})):
        want = sorted((i, n, n - len(kept.encode().split()), kept, (t or "") if n == len(kept.encode().split()) else kept)
                      for (i, t), (n, kept) in zip(rows, plain(rows, window)) if i is not None)
        got = automaton_dedup.remove_repeats(df, window=window, **kw).collect()
        assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
        none = sorted((n, kept) for (i, _), (n, kept) in zip(rows, plain(rows, window)) if i is None)
        assert sorted((r["n_words"], r["kept"]) for r in got if r["doc_id"] is None) == none


def test_empty_table(spark):
    assert automaton_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_very_long_text(spark):
    words = word_soup(4, 60_000, 5000).split()
    rows = [(2, " ".join(words)), (1, " ".join(words[30_000:30_100])), (3, "x" * 200_000)]
    got = {r["doc_id"]: r for r in automaton_dedup.remove_repeats(docs_of(
        spark, [t for _, t in rows], ids=[i for i, _ in rows])).collect()}
    assert (got[2]["n_words"], got[2]["n_removed"], got[1]["n_removed"], got[3]["n_words"]) == (60_000, 100, 0, 1)
    kept = " ".join(words[:30_000] + words[30_100:])
    assert hashlib.sha256(got[2]["kept"].encode()).digest() == hashlib.sha256(kept.encode()).digest()


def test_query(spark):
    same_as_oracle(spark, "op11_automaton_dedup")
