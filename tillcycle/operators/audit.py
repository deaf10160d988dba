"""Deterministic audit checks and pass/fail status per run (AU1-AU4, SO5, AG17, TK3, FI10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINDING_COLUMNS = ["run_id", "as_of_date", "severity", "finding_type", "description",
                   "affected_field", "reported_value", "verified_value"]

# Allowed severities and finding types; anything else is 'other'.
SEVERITIES = ["info", "warning", "error"]
FINDING_TYPES = ["number_mismatch", "missing_citation", "hallucinated_metric",
                 "policy_violation", "schema_drift", "other"]


def _finding(df: DataFrame, severity: str, ftype: str, description, field,
             reported=None, verified=None) -> DataFrame:
    s = lambda v: F.lit("") if v is None else v
    return df.select("run_id", "as_of_date", F.lit(severity).alias("severity"),
                     F.lit(ftype).alias("finding_type"), description.alias("description"),
                     field.alias("affected_field"), s(reported).alias("reported_value"),
                     s(verified).alias("verified_value"))


def audit(runs: DataFrame, kpis: DataFrame, decisions: DataFrame) -> DataFrame:
    """AU1-AU3 findings for every run (SO5: one union of all checks).

    kpis: run_id, name, evidence (NULL = uncited); runs: run_id, as_of_date,
    mode, period_end; decisions: run_id, rationale, n_actions.
    """
    k = kpis.where(F.col("evidence").isNull()) \
        .join(runs.select("run_id", "as_of_date"), "run_id")
    uncited = _finding(k, "warning", "missing_citation",
                       F.format_string("KPI '%s' has no SQL evidence attached.", F.col("name")),
                       F.format_string("kpis[%s].evidence", F.col("name")))
    late = runs.where((F.col("mode") == "bounded") & (F.col("period_end") > F.col("as_of_date")))
    policy = _finding(late, "error", "policy_violation",
                      F.format_string("Report period_end %s exceeds as_of_date %s in bounded mode.",
                                      F.col("period_end").cast("string"),
                                      F.col("as_of_date").cast("string")),
                      F.lit("period_end"), F.col("period_end").cast("string"),
                      F.col("as_of_date").cast("string"))
    d = decisions if "as_of_date" in decisions.columns else \
        decisions.join(runs.select("run_id", "as_of_date"), "run_id")
    no_rationale = _finding(d.where(F.trim(F.coalesce(F.col("rationale"), F.lit(""))) == ""),
                            "warning", "missing_citation",
                            F.lit("Manager decision has no rationale."), F.lit("rationale"))
    no_actions = _finding(d.where(F.col("n_actions") == 0), "error", "other",
                          F.lit("Manager decision has no actions."), F.lit("actions"))
    return uncited.unionByName(policy).unionByName(no_rationale).unionByName(no_actions)


def coerce_findings(df: DataFrame) -> DataFrame:
    """PR9: unknown finding types become 'other', NULL texts become ''."""
    ft = F.when(F.col("finding_type").isin(FINDING_TYPES), F.col("finding_type")).otherwise("other")
    out = df.withColumn("finding_type", ft)
    for c in ("description", "affected_field", "reported_value", "verified_value"):
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


def audit_status(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """AU4/AG17: counts by severity per run; passed = no error finding.
    Runs without findings appear as passed."""
    sev = F.col("severity")
    agg = findings.groupBy("run_id").agg(
        F.count_if(sev == "error").alias("errors"),
        F.count_if(sev == "warning").alias("warnings"),
        F.count_if(sev == "info").alias("infos"))
    j = runs.select("run_id").join(agg, "run_id", "left").na.fill(0, ["errors", "warnings", "infos"])
    return j.withColumn("passed", F.col("errors") == 0)


def top_findings(findings: DataFrame, n: int = 5, order_col: str | None = None) -> DataFrame:
    """TK3: first n findings per run, errors first, then warnings, info,
    anything else; stable within a severity by ``order_col`` (or type/field)."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1) \
        .when(F.col("severity") == "info", 2).otherwise(3)
    tie = [F.col(order_col)] if order_col else [F.col("finding_type"), F.col("affected_field"),
                                               F.col("description")]
    w = Window.partitionBy("run_id").orderBy(rank, *tie)
    return findings.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)
