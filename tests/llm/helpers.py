"""Small tables for the operators' tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def docs_of(spark, texts, sources=None, langs=None, ids=None):
    """Documents 0.. with these texts; sources and langs by position."""
    rows = [(i if ids is None else ids[i], t, langs[i] if langs else "en", sources[i] if sources else "s",
             None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def word_soup(seed, n, vocabulary=200):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def oracle_rows(name, sf=SF_SMALL):
    """The query's DuckDB rows, by column name."""
    import duckdb

    from tillcycle.llm.queries import SQL
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r, strict=True)) for r in cur.fetchall()]


def same_as_oracle(spark, name, sf=SF_SMALL):
    from tillcycle.llm.queries import QUERIES
    want = oracle_rows(name, sf)
    cols = sorted(want[0])
    got = [r.asDict() for r in QUERIES[name](spark, sf).collect()]

    def norm(rows):
        return sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in rows), key=repr)
    assert norm(got) == norm(want)
