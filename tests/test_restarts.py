import numpy as np

from conftest import SF_SMALL
from tillcycle.operators import restarts as RS
from tillcycle.operators.taxonomy import cluster_texts, product_texts, text_points
from tillcycle.session import cut_lineage
from tillcycle.sources.tables import fact_sales

POINTS = "id int, h long, f array<int>, w array<double>"


def points_of(spark, x, parts=3):
    rows = [(i, i * 7919 + 13, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]])
            for i, r in enumerate(x)]
    return spark.createDataFrame(rows, POINTS).repartition(parts)


def heaps(n=240, dims=6, groups=5):
    rng = np.random.default_rng(5)
    x = np.eye(dims)[rng.integers(0, groups, n)] * 10 + rng.normal(0, 0.3, (n, dims)) * (rng.random((n, dims)) < 0.5)
    x[::40] = 0.0
    return x


def plain(x, centres, iters, tol=1e-4):
    for _ in range(iters):
        near = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        to = np.array([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        if np.sqrt(((to - centres) ** 2).sum(axis=1)).max() <= tol:
            break
        centres = to
    return centres, ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum()


def test_restarts_equal_plain_ones(spark):
    x = heaps()
    points = points_of(spark, x).cache()
    k, n_init = 6, 4
    first = RS.seeds(points, k, n_init, x.shape[1], seed=3)
    assert all(np.isclose(x, row).all(axis=1).any() for row in first)          # drawn points
    centres, costs = RS.refine(points, first, n_init, max_iter=12)
    for r in range(n_init):
        want, cost = plain(x, first[r * k:(r + 1) * k], 12)
        assert np.allclose(centres[r * k:(r + 1) * k], want) and np.isclose(costs[r], cost)
    again = RS.seeds(points_of(spark, x, parts=7), k, n_init, x.shape[1], seed=3)
    assert np.allclose(first, again)
    best = int(costs.argmin())
    got = {r.id: r.cluster_id for r in RS.best_of_restarts(points, "id", k, n_init, x.shape[1], seed=3, max_iter=12).collect()}
    d = ((x[:, None] - centres[best * k:(best + 1) * k]) ** 2).sum(axis=2)
    assert all(np.isclose(d[i, c], d[i].min()) for i, c in got.items()) and len(got) == len(x)
    points.unpersist()


def test_few_points_and_none(spark):
    same = points_of(spark, np.ones((9, 3)))
    assert {r.cluster_id for r in RS.best_of_restarts(same, "id", 3, 2, 3).collect()} == {0}
    assert RS.best_of_restarts(spark.createDataFrame([], POINTS), "id", 3, 2, 3).count() == 0


def test_best_cost_beside_single_fits_and_jobs(spark):
    """On the products: no worse than the best of as many fits one after another, in about as many
    jobs for six restarts as for one."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    dims, k, n_init = 256, 8, 6
    texts = product_texts(fact_sales(spark, SF_SMALL, ["stock_code", "description"])).select("clean_desc").distinct()
    points = cut_lineage(text_points(texts, dims))
    jobs = {}
    for n in (1, n_init):
        spark.sparkContext.setJobGroup(f"restarts-{n}", "")
        _, costs = RS.refine(points, RS.seeds(points, k, n, dims), n)
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"restarts-{n}"))
    spark.sparkContext.setJobGroup("rest", "")
    dense = spark.createDataFrame([(_dense(r, dims),) for r in points.collect()], "v array<double>") \
        .select(array_to_vector("v").alias("v")).cache()
    single = min(KMeans(k=k, seed=s, featuresCol="v", maxIter=50).fit(dense).summary.trainingCost for s in range(n_init))
    assert costs.min() <= 1.02 * single
    assert 0 < jobs[n_init] <= 3 * jobs[1]


def _dense(row, dims):
    v = np.zeros(dims)
    v[row.f] = row.w
    return v.tolist()


def test_clusters_of_texts(spark):
    rows = [(f"s{i}", t) for i, t in enumerate(["red mug", "red mug", "blue lamp", "??", "", "tin box"]) if t]
    texts = product_texts(spark.createDataFrame(rows, "stock_code string, description string"))
    got = {r.clean_desc: r.cluster_id for r in cluster_texts(texts, 30, n_init=2, num_features=64).collect()}
    assert len(got) == texts.select("clean_desc").distinct().count() and len(set(got.values())) == len(got)
