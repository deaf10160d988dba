import random
import re
import zlib
from collections import Counter, defaultdict

from llm.helpers import DOCS, SF_MID, docs_of

from tillcycle.llm import spelling
from tillcycle.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counted(rows, slip=199):
    out = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if slip and h % slip == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(n):
    """All pairs of words compared, by way of all strings with one code point left out."""
    shapes = defaultdict(set)
    for w in n:
        shapes[w].add(w)
        for i in range(len(w)):
            shapes[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in shapes.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_one_edit_is_what_the_plain_version_says():
    assert one_edit("abc", "abcd") and one_edit("abc", "abd") and not one_edit("abc", "acb") and not one_edit("abc", "abc")


def test_near_pairs_against_all_pairs(spark):
    rnd = random.Random(4)
    some = set()
    for alphabet, size in (("ab", 7), ("ab", 8), ("abcé", 6), ("abÿ", 9)):
        some |= {"".join(rnd.choice(alphabet) for _ in range(size + rnd.randint(0, 2))) for _ in range(120)}
    some |= {"common" + "".join(rnd.choice("xyzÀ") for _ in range(rnd.randint(2, 5))) for _ in range(150)}
    some |= {"".join(rnd.choice("xyzÀ") for _ in range(rnd.randint(2, 5))) + "common" for _ in range(150)}
    some = sorted(some)
    want = sorted((a, b) if (len(a), a) < (len(b), b) else (b, a) for i, a in enumerate(some) for b in some[:i] if one_edit(a, b))
    df = spark.createDataFrame([(w, i) for i, w in enumerate(some)], "word string, n long")
    for crowd in (1 << 16, 300, 1):
        got = spelling.near_pairs(df, max_meetings=crowd).collect()
        assert sorted((r["a"], r["b"]) for r in got) == want
        assert all(some[r["n_a"]] == r["a"] and some[r["n_b"]] == r["b"] for r in got)


def test_chains_ties_nulls_and_repeats(spark):
    rows = [(1, "planet " * 1600), (2, "planets " * 300), (3, "planetss " * 40), (4, "planetsss " * 5), (None, "planetsss"),
            (5, None), (6, ""), (7, "PLANEt Étoile étoile ÉTOILE " * 3), (8, "kanton " * 50 + "kantan " * 50 + "kantun " * 10),
            (9, "short word " * 9), (10, "rarely " * 4), (7, "PLANEt Étoile étoile ÉTOILE " * 3), (11, "aaaaaa×÷b " * 6),
            (12, "q" * 5000 + " " + "q" * 5001), (13, ("q" * 5000 + " ") * 30 + ("q" * 5001 + " ") * 5)]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS).withColumnRenamed("lang", "word")
    for slip in (199, 2, None):
        got = rows_of(spelling.variants(df.withColumnRenamed("source", "n"), slip=slip, max_meetings=2))
        assert got == plain(counted(rows, slip))
    roots = {w: r for w, _, r, *_ in got}
    assert roots["planetsss"] == "planet" and ("kantun", "kantan", "kantan", 10, 2, 50) in got


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(docs_of(spark, [None, "", "x"])).count() == 0


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    got = rows_of(QUERIES["op13_qchunk_spelling"](spark, SF_MID))
    assert got == plain(counted(rows)) and len(got) > 100
