import random

import duckdb
from llm.helpers import same_as_oracle

from tillcycle.llm import url_templates as ut

PAGES, LABELS = "page_id long, url string, host string", "page_id long, bad boolean"


def judged(spark, urls, labels=(), **kw):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], PAGES)
    rows = ut.judge(pages, spark.createDataFrame(list(labels), LABELS), **kw).collect()
    return {r["page_id"]: r for r in rows}


def test_hosts_paths_and_rules(spark):
    cases = {None: ("", "", None), "no scheme/x": ("", "", None), "HTTP://A.Example.ORG": ("a.example.org", "", None),
             "http://example.org/es/1?x=/": ("example.org", "/es/1", ("example.org/es/", "block")),
             "http://a.example.org/en/1#f": ("a.example.org", "/en/1", ("example.org/en/1", "block")),
             "http://badexample.org/es/": ("badexample.org", "/es/", ("org/", "allow")),
             "x://b.com/de/q://r": ("b.com", "/de/q://r", ("com/de/", "block")),
             "http://com/fr/É": ("com", "/fr/É", ("com/fr/", "allow")), "://": ("", "", None),
             "http://é.com?/de/": ("é.com", "", None), "http://x.net/\nde": ("x.net", "/\nde", None)}
    got = judged(spark, list(cases))
    for i, (host, path, rule) in enumerate(cases.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
        assert r["verdict"] == (rule[1] if rule else "allow")


def test_bad_templates_are_rejected(spark):
    urls = ([f"http://h.net/shop/item{i}.html" for i in range(200)] + [f"http://h.net/news/{i}" for i in range(200)]
            + [f"http://h.net/blog/{i}" for i in range(200)] + [f"http://g.net/{w}" for w in "abcdefghijklmnopqrstuvwxyz"])
    labels = [(i, i < 200 or i % 40 == 0) for i in range(0, 600, 2)] + [(5, True), (5, None)]
    got = judged(spark, urls, labels)
    assert {r["template"] for r in got.values()} == {"/shop/item<n>.html", "/news/<n>", "/blog/<n>", "/*"}
    assert {i for i, r in got.items() if r["verdict"] == "block"} == set(range(200))
    shares = {i: got[i]["bad_share"] for i in (0, 200, 400)}
    assert shares[200] == shares[400] < 0.5 < shares[0]  # the similar branches are one
    assert {r["verdict"] for r in judged(spark, urls + urls[:3]).values()} == {"allow"}  # no label


def test_empty_and_query(spark):
    assert not judged(spark, [])
    same_as_oracle(spark, "op9_url_templates")


def test_paths_below_the_third_segment(spark):
    urls = [f"http://h.net/a/b/c/{w}/{w}{i}" for w in ("spam", "news", "blog") for i in range(200)]
    urls += ["http://h.net/a/b/c/" + "/".join(f"d{i}" for i in range(300)), "http://h.net/a/b/c", "http://h.net/a/b/c/"]
    got = judged(spark, urls, [(i, i < 200) for i in range(0, 600, 2)])
    assert {got[i]["template"] for i in range(600)} == {f"/a/b/c/{w}/{w}<n>" for w in ("spam", "news", "blog")}
    assert {i for i, r in got.items() if r["verdict"] == "block"} == set(range(200))
    assert [got[i]["template"] for i in (600, 601, 602)] == [u[len("http://h.net"):] for u in urls[600:]]


def test_deep_paths_as_the_sql_of_their_depth(spark):
    rnd = random.Random(9)
    seg = lambda: rnd.choice(["", "~", "*", "a", "b", f"p{rnd.randrange(30)}", f"{rnd.choice('klmnopqrstuvwx')}z"])
    urls = [f"http://h{rnd.randrange(3) // 2}.net" + "".join(f"/{seg()}" for _ in range(rnd.randrange(7)))
            for _ in range(2500)]
    bad = [int("/a" in u or rnd.random() < 0.2) for u in urls]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.execute("INSERT INTO pages SELECT unnest(?), unnest(?)", [list(range(len(urls))), urls])
    con.execute("INSERT INTO labels SELECT unnest(?), 1, unnest(?)", [list(range(0, len(urls), 2)), bad[::2]])
    want = {r[0]: r[1:] for r in con.execute(ut.sql(6)).fetchall()}
    rows = judged(spark, urls, [(i, bool(bad[i])) for i in range(0, len(urls), 2)])
    assert {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in rows.items()} == want
    assert {w[3] for w in want.values()} == {"allow", "block"}
    shares = con.execute(ut.sql(6).replace("SELECT page_id, d.host", "SELECT page_id, share, d.host")).fetchall()
    assert all(abs(rows[i]["bad_share"] - x) < 1e-9 for i, x, *_ in shares)
