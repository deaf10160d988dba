"""Offline evaluators over every stored run at once (EV1-EV7, JO5, JO6, JO8,
JO11, AG7, AG13, AG14, AG20-AG24, SO7).

Per-run reference data (KPI values, KPI names) has a fixed size per run
(five KPIs), so it is attached to each run as a small array and matched
inside the row (``exists``), never through a nested-loop join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.operators.demand import key_list
from tillcycle.session import bounded_broadcast

# Fixed value: the numeric-token pattern of the narrative check.
NUMBER_PATTERN = r"[£$€]?\d[\d,]*\.?\d*%?"


# ------------------------------------------------------------ factuality
def kpi_check(stored: DataFrame, recomputed: DataFrame, tol: float = 0.01,
              first_columns: DataFrame | None = None) -> DataFrame:
    """EV1 per KPI: stored (run_id, name, value, evidence) against
    recomputed (run_id, name, value) by name; rel. error
    |stored - re| / max(|re|, 1e-9).  Output adds recomputed, rel_error,
    status in {verified, mismatch, not_recomputed, no_evidence}.

    ``first_columns`` (run_id, evidence, value) reproduces the reference's
    quirk Q4 instead: every KPI is compared with the first numeric column
    of its evidence query (so orders, order value and customers are
    compared with revenue)."""
    if first_columns is not None:
        re = first_columns.select("run_id", "evidence", F.col("value").alias("recomputed"))
        j = stored.join(re, ["run_id", "evidence"], "left")
    else:
        re = recomputed.select("run_id", "name", F.col("value").alias("recomputed"))
        j = stored.join(re, ["run_id", "name"], "left")
    rel = F.abs(F.col("value") - F.col("recomputed")) / \
        F.greatest(F.abs(F.col("recomputed")), F.lit(1e-9))
    status = F.when(F.col("evidence").isNull(), "no_evidence") \
        .when(F.col("recomputed").isNull(), "not_recomputed") \
        .when(rel <= tol, "verified").otherwise("mismatch")
    return j.withColumn("rel_error", rel).withColumn("status", status)


def narrative_numbers(narratives: DataFrame, stored: DataFrame) -> DataFrame:
    """EV2/JO11: numeric tokens of each run's narrative that are not within
    1 % of any (2-dp rounded) KPI value of the run.

    Output: run_id, n_numbers, n_unsupported, unsupported (array of tokens).
    """
    kv = stored.groupBy("run_id").agg(F.collect_list(F.round("value", 2)).alias("kv"))
    n = narratives.join(kv, "run_id", "left")
    toks = F.regexp_extract_all(F.col("narrative"), F.lit(NUMBER_PATTERN), 0)
    n = n.withColumn("toks", toks)
    parsed = F.transform("toks", lambda t: F.struct(
        t.alias("t"), F.regexp_replace(t, "[£$€,%]", "").try_cast("double").alias("v")))
    kvs = F.coalesce(F.col("kv"), F.array().cast("array<double>"))

    def unsupported(e):
        near = F.exists(kvs, lambda k: F.abs(F.round(e["v"], 2) - k) /
                        F.greatest(F.abs(k), F.lit(1e-9)) < 0.01)
        return e["v"].isNotNull() & ~near

    bad = F.transform(F.filter(parsed, unsupported), lambda e: e["t"])
    return n.select("run_id", F.size("toks").alias("n_numbers"),
                    F.size(bad).alias("n_unsupported"), bad.alias("unsupported"))


def eval_factuality(stored: DataFrame, recomputed: DataFrame, narratives: DataFrame,
                    tol: float = 0.01, pass_at: float = 0.8,
                    first_columns: DataFrame | None = None) -> DataFrame:
    """EV1-EV3 per run: counts, factuality_score (verified / with evidence,
    1.0 when nothing has evidence), narrative check, PASS/FAIL.
    ``first_columns``: see ``kpi_check`` (quirk Q4 reproduction)."""
    c = kpi_check(stored, recomputed, tol, first_columns)
    s = F.col("status")
    agg = c.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_kpis"),
        F.count_if(s != "no_evidence").alias("kpis_with_evidence"),
        F.count_if(s == "verified").alias("kpis_verified"),
        F.count_if(s == "mismatch").alias("kpis_mismatched"),
        F.count_if(s == "no_evidence").alias("kpis_no_evidence"))
    score = F.when(F.col("kpis_with_evidence") == 0, F.lit(1.0)) \
        .otherwise(F.col("kpis_verified") / F.col("kpis_with_evidence"))
    out = agg.withColumn("factuality_score", F.round(score, 6))
    out = out.join(narrative_numbers(narratives, stored).drop("unsupported"), "run_id", "left")
    return out.withColumn("verdict", F.when(F.col("factuality_score") >= pass_at, "PASS")
                          .otherwise("FAIL"))


# ------------------------------------------------------------ forecasting
def eval_forecast(forecast: DataFrame, backtest: DataFrame, actuals: DataFrame,
                  key) -> tuple[DataFrame, DataFrame]:
    """EV4: per key accuracy and per-run summary.

    forecast: *key, ds, yhat; backtest: *key, mape; actuals: *key, ds, y.
    Only dates present in both are scored (JO5/SO7); MAPE skips zero
    actuals; keys without actuals keep NULL metrics and n_actuals 0;
    reliable = actual MAPE <= 2 x backtest MAPE (AG20).  Per run (the first
    key column): unweighted means over keys (AG21).
    """
    ks = key_list(key)
    fk = forecast.select(*ks).distinct()
    n_act = actuals.groupBy(*ks).agg(F.count(F.lit(1)).alias("n_actuals"))
    both = forecast.select(*ks, "ds", "yhat").join(actuals.select(*ks, "ds", "y"), ks + ["ds"])
    err = both.groupBy(*ks).agg(
        F.avg(F.when(F.col("y") > 0, F.abs(F.col("y") - F.col("yhat")) / F.col("y")))
        .alias("actual_mape"),
        F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2)).alias("actual_rmse"))
    per = fk.join(n_act, ks, "left").join(err, ks, "left") \
        .join(backtest.select(*ks, F.col("mape").alias("backtest_mape")), ks, "left") \
        .withColumn("n_actuals", F.coalesce("n_actuals", F.lit(0)))
    none = F.col("n_actuals") == 0
    per = per.withColumn("actual_mape", F.when(~none, F.round("actual_mape", 6))) \
        .withColumn("actual_rmse", F.when(~none, F.round("actual_rmse", 6)))
    per = per.withColumn("backtest_is_reliable",
                         F.col("actual_mape") <= 2.0 * F.col("backtest_mape"))
    run = ks[0]
    summary = per.groupBy(run).agg(
        F.count(F.lit(1)).alias("total_skus_forecasted"),
        F.count_if(F.col("n_actuals") > 0).alias("skus_with_actuals"),
        F.round(F.avg("actual_mape"), 6).alias("overall_actual_mape"),
        F.round(F.avg("actual_rmse"), 6).alias("overall_actual_rmse"))
    return per, summary


def forecast_reliability(backtest: DataFrame, by: str = "run_id", threshold: float = 1.0) -> DataFrame:
    """AG13: mean backtest MAPE over keys that have one; RELIABLE when
    <= threshold, NOT RELIABLE above, UNKNOWN without any MAPE."""
    a = backtest.groupBy(by).agg(F.avg("mape").alias("avg_mape"))
    v = F.when(F.col("avg_mape").isNull(), "UNKNOWN") \
        .when(F.col("avg_mape") <= threshold, "RELIABLE").otherwise("NOT RELIABLE")
    return a.select(by, F.round("avg_mape", 6).alias("avg_mape"), v.alias("verdict"))


def forecast_usable(backtest: DataFrame, by: str = "run_id", threshold: float = 0.5) -> DataFrame:
    """AG14: usable unless no metrics, mean MAPE > threshold, or more than
    half of the keys with a MAPE exceed it."""
    a = backtest.groupBy(by).agg(
        F.avg("mape").alias("avg_mape"), F.count("mape").alias("n_valid"),
        F.count_if(F.col("mape") > threshold).alias("n_high"))
    usable = F.when(F.col("n_valid") == 0, False) \
        .otherwise(~((F.col("avg_mape") > threshold) | (F.col("n_high") > F.col("n_valid") * 0.5)))
    return a.select(by, usable.alias("usable"), F.round("avg_mape", 6).alias("avg_mape"),
                    "n_valid", "n_high")


# ------------------------------------------------------------ decisions
def score_actions(actions: DataFrame, decisions: DataFrame, kpi_names: DataFrame) -> DataFrame:
    """EV5 per action: 0.5 for a stock_code/category, 0.5 when the run's
    rationale or the action description names a known KPI (as written or
    with spaces, case-insensitive); without known KPI names, a non-blank
    description counts instead."""
    names = kpi_names.groupBy("run_id").agg(F.collect_set("name").alias("kpi_names"))
    d = decisions.select("run_id", "rationale").join(names, "run_id", "left")
    a = actions.join(bounded_broadcast(d), "run_id", "left")   # one row per run
    text = F.lower(F.concat_ws(" ", F.coalesce("rationale", F.lit("")),
                               F.coalesce("description", F.lit(""))))
    kn = F.coalesce(F.col("kpi_names"), F.array().cast("array<string>"))
    mentions = F.exists(kn, lambda n: text.contains(F.regexp_replace(F.lower(n), "_", " "))
                        | text.contains(F.lower(n)))
    refs = F.when(F.size(kn) > 0, mentions) \
        .otherwise(F.trim(F.coalesce("description", F.lit(""))) != "")
    target = (F.coalesce("stock_code", F.lit("")) != "") | (F.coalesce("category", F.lit("")) != "")
    return a.select(*actions.columns, target.alias("has_target"), refs.alias("refs_kpi"),
                    (F.when(target, 0.5).otherwise(0.0) + F.when(refs, 0.5).otherwise(0.0))
                    .alias("score"))


def eval_decisions(decisions: DataFrame, actions: DataFrame, kpi_names: DataFrame,
                   pass_at: float = 0.6) -> DataFrame:
    """EV6/EV7 per run: checks, confidence flag, unknown KPI references
    (JO8), weighted score 0.2/0.2/0.1/0.1/0.4 rounded to 3, PASS at 0.6."""
    sc = score_actions(actions, decisions, kpi_names).groupBy("run_id").agg(
        F.avg("score").alias("c_actions"), F.count(F.lit(1)).alias("n_scored"),
        F.count_if(~F.col("has_target")).alias("vague_actions"))
    names = kpi_names.groupBy("run_id").agg(F.collect_set("name").alias("kpi_names"))
    d = decisions.join(sc, "run_id", "left").join(names, "run_id", "left")
    rat = F.trim(F.coalesce("rationale", F.lit("")))
    has_rat = F.length(rat) > 20
    has_k = F.size("kpi_references") > 0
    has_f = F.size("forecast_references") > 0
    kn = F.coalesce(F.col("kpi_names"), F.array().cast("array<string>"))
    unknown = F.when((F.size(kn) > 0) & has_k, F.array_except("kpi_references", kn)) \
        .otherwise(F.array().cast("array<string>"))
    conf = F.col("confidence")
    flag = F.when(conf >= 0.99, "suspiciously_high").when(conf < 0.2, "suspiciously_low") \
        .otherwise("ok")
    c_act = F.coalesce(F.col("c_actions"), F.lit(0.0))
    score = F.round(0.2 * has_rat.cast("double") + 0.2 * has_k.cast("double")
                    + 0.1 * has_f.cast("double") + 0.1 * (flag == "ok").cast("double")
                    + 0.4 * c_act, 3)
    n_find = has_rat.cast("int") * 0 + (~has_rat).cast("int") + (~has_k).cast("int") \
        + (~has_f).cast("int") + (F.size(unknown) > 0).cast("int") + (flag != "ok").cast("int") \
        + (F.coalesce("n_scored", F.lit(0)) == 0).cast("int") \
        + F.coalesce("vague_actions", F.lit(0)).cast("int")
    return d.select(
        "run_id", F.coalesce("n_scored", F.lit(0)).alias("total_actions"),
        score.alias("overall_score"), has_rat.alias("has_rationale"),
        has_k.alias("has_kpi_references"), has_f.alias("has_forecast_references"),
        F.array_join(unknown, ";").alias("unknown_kpi_references"),
        conf.alias("confidence"), flag.alias("confidence_flag"),
        F.coalesce("vague_actions", F.lit(0)).alias("vague_actions"),
        n_find.alias("n_findings"),
        F.when(score >= pass_at, "PASS").otherwise("FAIL").alias("verdict"))


# The sentences of the decision and forecast findings.
NO_RATIONALE = "Decision rationale is absent or too short (< 20 chars)."
NO_KPI_REFERENCES = "Decision has no kpi_references — KPI grounding cannot be verified."
NO_FORECAST_REFERENCES = "Decision has no forecast_references."
UNKNOWN_KPIS = "KPI references not found in analyst report: ['%s']"
TOO_SURE = "Confidence is %.2f — suspiciously high. Manager should express uncertainty."
TOO_UNSURE = "Confidence is %.2f — suspiciously low."
NO_ACTIONS = "Decision has no actions."
VAGUE_ACTION = "Action '%s' has no stock_code or category — too vague."
NO_ACTUALS = "SKU %s: no actuals found beyond %s — forecast vs actual comparison not possible."


def decision_findings(scores: DataFrame, actions: DataFrame) -> DataFrame:
    """EV6: one row per finding, run_id and finding: the decision-level ones
    from ``eval_decisions``' columns, and one per action without a target (in
    a table of their own rows, so a run's list is never one value)."""
    flag = F.col("confidence_flag")
    unknown = F.regexp_replace("unknown_kpi_references", ";", "', '")
    checks = [
        F.when(~F.col("has_rationale"), NO_RATIONALE),
        F.when(~F.col("has_kpi_references"), NO_KPI_REFERENCES),
        F.when(~F.col("has_forecast_references"), NO_FORECAST_REFERENCES),
        F.when(F.col("unknown_kpi_references") != "", F.format_string(UNKNOWN_KPIS, unknown)),
        F.when(flag == "suspiciously_high", F.format_string(TOO_SURE, F.col("confidence")))
        .when(flag == "suspiciously_low", F.format_string(TOO_UNSURE, F.col("confidence"))),
        F.when(F.col("total_actions") == 0, NO_ACTIONS)]
    whole = scores.select("run_id", F.explode(F.array(*checks)).alias("finding")).where("finding is not null")
    vague = actions.where((F.coalesce("stock_code", F.lit("")) == "") & (F.coalesce("category", F.lit("")) == ""))
    return whole.unionByName(vague.select("run_id", F.format_string(VAGUE_ACTION, F.col("action_type")).alias("finding")))


def forecast_warnings(per_key: DataFrame, runs: DataFrame) -> DataFrame:
    """EV4: a warning per forecast key without actuals (run_id, stock_code, warning)."""
    as_of = bounded_broadcast(runs.select("run_id", F.col("as_of_date").cast("string").alias("_as_of")))
    return per_key.where(F.col("n_actuals") == 0).join(as_of, "run_id").select(
        "run_id", "stock_code", F.format_string(NO_ACTUALS, F.col("stock_code"), F.col("_as_of")).alias("warning"))


def with_missing(runs: DataFrame, results: DataFrame) -> DataFrame:
    """SC10: every run asked for with its results and a status, `scored` or,
    where the artifact to score was never stored, `missing_artifact`."""
    r = results.withColumn("_there", F.lit(True))
    return runs.select("run_id").join(r, "run_id", "left").withColumn(
        "status", F.when(F.col("_there"), "scored").otherwise("missing_artifact")).drop("_there")
