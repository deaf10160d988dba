import random

from pyspark.sql import functions as F

from tillcycle.operators.pruned_terms import pruned_topk, term_index
from tillcycle.operators.retrieval import terms_topk, tfidf_terms
from tillcycle.session import cut_lineage


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in df.collect())


def test_same_rows_as_scoring_everything(spark):
    rnd = random.Random(2)
    words = [f"w{int(rnd.paretovariate(0.6)) % 400}" for _ in range(40_000)]
    texts = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40)))) for i in range(1500)]
    texts += [(2000 + i, texts[i % 7][1]) for i in range(40)]        # copies: ties
    texts += [(3000, ""), (3001, None), (-60, "nothing shared"), (-61, "")]
    texts += [(-i - 1, texts[i][1] + " w1 w2") for i in range(50)]
    both = cut_lineage(tfidf_terms(spark.createDataFrame(texts, "id long, text string"), "id"))
    corpus, queries = both.where("id >= 0"), both.where("id < 0").withColumnRenamed("id", "query_id")
    for k, per_doubling, strongest, pilots in ((3, 4, 3, 30), (1, 1, 1, 1), (5000, 2, 4, 30)):
        top, _ = pruned_topk(term_index(corpus, per_doubling=per_doubling), queries, k=k, strongest=strongest, pilots=pilots)
        assert rows_of(top) == rows_of(terms_topk(corpus, queries, k=k))


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, term string, w double")
    some = spark.createDataFrame([(1, "a", 1.0)], "id long, term string, w double")
    for corpus, queries in ((none, some), (some, none)):
        top, work = pruned_topk(term_index(corpus), queries.withColumnRenamed("id", "query_id"))
        assert top.count() == 0 and work.count() == 0


def test_common_words_are_hardly_read(spark):
    """Passages of a few rare words among common ones, each in a few texts."""
    rnd = random.Random(4)
    filler = lambda n: " ".join(f"c{rnd.randrange(30)}" for _ in range(n))
    passages = [" ".join(f"r{rnd.randrange(4000)}" for _ in range(8)) for _ in range(20)]
    texts = [(i, f"{filler(40)} r{rnd.randrange(4000)}") for i in range(4000)]
    texts += [(5000 + 4 * i + j, f"{filler(12)} {p}") for i, p in enumerate(passages) for j in range(4)]
    texts += [(-i - 1, f"{p} {filler(12)}") for i, p in enumerate(passages)]
    both = cut_lineage(tfidf_terms(spark.createDataFrame(texts, "id long, text string"), "id"))
    corpus, queries = both.where("id >= 0"), both.where("id < 0").withColumnRenamed("id", "query_id")
    top, work = pruned_topk(term_index(corpus), queries, k=3)
    assert rows_of(top) == rows_of(terms_topk(corpus, queries, k=3))
    w = work.agg(F.sum("hits_all").alias("a"), F.sum("hits_scored").alias("s")).first()
    print(f"postings of the passages' terms {w.a}, scored {w.s}")
    assert w.a > 500_000 and w.s < w.a / 10
