"""Report-edge computations of the UI/PDF layer, as DataFrame jobs
(AG19, AG25, PR11, PR12, PR14, PR15, TK4, TK5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcycle.functions.topk import top_k_per_group
from tillcycle.session import cut_lineage


def kpi_view(kpis: DataFrame) -> DataFrame:
    """PR11: display label = name with '_' as space, title case."""
    return kpis.withColumn("label", F.initcap(F.regexp_replace("name", "_", " ")))


def forecast_view(forecast: DataFrame, key: str) -> DataFrame:
    """PR12: forecast rows for display, 1 dp, display column names."""
    return forecast.select(F.col(key), F.col("ds").alias("date"),
                           F.round("yhat", 1).alias("forecast"),
                           F.round("yhat_lower", 1).alias("lower"),
                           F.round("yhat_upper", 1).alias("upper"))


def ranked_skus(skus: DataFrame, by: list[str] | None = None, k: int = 10) -> DataFrame:
    """TK5: re-sort by revenue (NULL as 0), first k, 1-based rank."""
    by = by or []
    rev = F.coalesce(F.col("total_revenue"), F.lit(0.0))
    s = skus.withColumn("_rev", rev)
    return top_k_per_group(s, by, [F.col("_rev").desc(), F.col("stock_code")], k,
                           salt_cols=["stock_code"], buckets=8).drop("_rev")


def concentration(skus: DataFrame, by: list[str] | None = None, top: int = 5) -> DataFrame:
    """AG19: revenue of the best ``top`` of a ranked SKU list, its total and share."""
    by = by or []
    r = ranked_skus(skus, by, 10)
    rev = F.coalesce(F.col("total_revenue"), F.lit(0.0))
    return r.groupBy(*by).agg(
        F.round(F.sum(F.when(F.col("rank") <= top, rev).otherwise(0.0)), 2).alias("top5_revenue"),
        F.round(F.sum(rev), 2).alias("top10_revenue")) \
        .withColumn("top5_share", F.round(F.try_divide(F.col("top5_revenue"),
                                                      F.col("top10_revenue")), 4))


def urgency_rank() -> Column:
    return F.when(F.col("urgency") == "high", 0).when(F.col("urgency") == "medium", 1) \
        .when(F.col("urgency") == "low", 2).otherwise(3)


def top_actions(actions: DataFrame, n: int = 5, tie: str = "action_id") -> DataFrame:
    """TK4: first n actions per run by urgency high < medium < low, stable
    by ``tie``; a run with many actions is ranked in salted pieces."""
    a = actions.withColumn("_u", urgency_rank())
    return top_k_per_group(a, ["run_id"], [F.col("_u"), F.col(tie)], n, salt_cols=[tie],
                           rank_col="pos").drop("_u")


def run_overview(runs: DataFrame, decisions: DataFrame, summary: DataFrame | None,
                 status: DataFrame | None, reports: DataFrame | None,
                 tasks: DataFrame | None) -> DataFrame:
    """AG25: one row per run of the overview counts; missing stages take the
    defaults not_reviewed (control), pending (audit), skipped (dispatch)."""
    o = runs.select("run_id").join(decisions.select("run_id", "n_actions"), "run_id", "left")
    if summary is not None:
        o = o.join(summary.select("run_id", "auto_release", "held", "blocked", "overall_state"),
                   "run_id", "left")
    else:
        o = o.select("*", *[F.lit(None).cast("long").alias(c) for c in ("auto_release", "held",
                                                                        "blocked")],
                     F.lit(None).cast("string").alias("overall_state"))
    if status is not None:
        o = o.join(status.select("run_id", "errors", "warnings", "passed"), "run_id", "left")
    else:
        o = o.select("*", F.lit(None).cast("long").alias("errors"),
                     F.lit(None).cast("long").alias("warnings"),
                     F.lit(None).cast("boolean").alias("passed"))
    if reports is not None:
        o = o.join(reports.select("run_id", F.col("status").alias("dispatch_status")),
                   "run_id", "left")
    else:
        o = o.withColumn("dispatch_status", F.lit(None).cast("string"))
    if tasks is not None:
        o = o.join(tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("released_tasks")),
                   "run_id", "left")
    else:
        o = o.withColumn("released_tasks", F.lit(None).cast("long"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return o.select(
        "run_id", z("n_actions").alias("actions"), z("released_tasks").alias("released_tasks"),
        z("auto_release").alias("auto_release"), z("held").alias("held"),
        z("blocked").alias("blocked"), z("errors").alias("errors"),
        z("warnings").alias("warnings"),
        F.coalesce("overall_state", F.lit("not_reviewed")).alias("control_state"),
        F.when(F.col("passed"), "passed").when(~F.col("passed"), "failed")
        .otherwise("pending").alias("audit_state"),
        F.coalesce("dispatch_status", F.lit("skipped")).alias("dispatch_status"))


def canonical(df: DataFrame) -> list[Column]:
    """Every column as text that any engine writes alike: fractions with six
    decimals, NULL as \\N."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.round(c, 6).cast("decimal(38,6)")
        out.append(F.coalesce(c.cast("string"), F.lit("\\N")).alias(name))
    return out


def fingerprint(df: DataFrame) -> DataFrame:
    """PR15 at scale: an order-insensitive fingerprint of a result — row
    count plus the sums of two 60-bit halves of each row's MD5 (one partial
    aggregate, no sort; repeated rows count as often as they are there).
    The reference's sorted-JSON sha256 would need the whole result in one
    place."""
    h = F.md5(F.concat_ws("|", *canonical(df)))
    half = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.concat_ws(":", F.coalesce(F.sum(half(1)), F.lit(0)).cast("string"),
                              F.coalesce(F.sum(half(16)), F.lit(0)).cast("string")).alias("fingerprint"))


def evidence(df: DataFrame, name: str, params: list[str], sql: str = "", preview_rows: int = 5,
             stored: bool = False) -> DataFrame:
    """PR14: evidence record of a query result: step name, parameters, the
    query text, a JSON preview of the first ``preview_rows`` rows in the order
    of all columns, the row count and the fingerprint.  The result is written
    once (unless it is a ``stored`` table) and read for both; only the preview rows are
    gathered into one value."""
    df = df if stored else cut_lineage(df)
    text = df.select(*canonical(df))
    first = text.orderBy(*df.columns).limit(preview_rows)
    prev = first.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("result_preview"))
    a = prev.select("result_preview", F.lit(None).cast("long").alias("rows"),
                    F.lit(None).cast("string").alias("fingerprint"))
    b = fingerprint(df).select(F.lit(None).cast("string").alias("result_preview"), "rows", "fingerprint")
    # two one-row aggregates side by side: a union + max keeps it join-free
    one = a.unionByName(b).agg(*[F.max(c).alias(c) for c in ("result_preview", "rows", "fingerprint")])
    return one.select(F.lit(name).alias("run_at"), F.array(*[F.lit(str(p)) for p in params]).alias("params"),
                      F.lit(sql).alias("sql"), "*")
