"""Run artifacts as JSON rows: write, newest per (run, type), per-run map,
recent-run listing, existence probe (SC6-SC13, JO3).

Artifacts are append-only rows (run_id, artifact_type, artifact_json,
created_at).  Reading "the latest" is an aggregation (``max_by`` on
created_at) rather than a window sort, so it combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARTIFACT_COLUMNS = ["run_id", "artifact_type", "artifact_json", "created_at"]

# Artifact types written per run.
ARTIFACT_TYPES = ["analyst_report", "forecast_report", "decision", "control_review",
                  "audit_report", "dispatch_report", "worker_tasks"]


def to_artifacts(df: DataFrame, artifact_type: str, payload: Column,
                 created_at: Column | None = None) -> DataFrame:
    """SC6: one artifact row per input row; NULL payloads are skipped and
    NULL fields are kept in the JSON (``ignoreNullFields`` off)."""
    ts = created_at if created_at is not None else F.current_timestamp().cast("timestamp_ntz")
    out = df.select("run_id", F.lit(artifact_type).alias("artifact_type"),
                    F.to_json(payload, {"ignoreNullFields": "false"}).alias("artifact_json"),
                    ts.alias("created_at"))
    return out.where(F.col("artifact_json").isNotNull())


def append(df: DataFrame, path: str) -> None:
    """SC6-SC9: append rows to a Parquet table (never rewrites old rows)."""
    df.write.mode("append").parquet(path)


def latest_artifacts(artifacts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """SC10: the newest artifact per (run, type)."""
    a = artifacts if types is None else artifacts.where(F.col("artifact_type").isin(types))
    latest = a.groupBy("run_id", "artifact_type").agg(
        F.max_by(F.struct("artifact_json", "created_at"), "created_at").alias("l"))
    return latest.select("run_id", "artifact_type", "l.artifact_json", "l.created_at")


def artifact_map(artifacts: DataFrame) -> DataFrame:
    """SC11: run_id -> map(type -> json) of the newest artifact of each type
    (at most one entry per artifact type, so the map size is fixed)."""
    latest = latest_artifacts(artifacts)
    return latest.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("artifact_type", "artifact_json")))
        .alias("artifacts"))


def recent_runs(decision_log: DataFrame, artifacts: DataFrame, limit: int = 20) -> DataFrame:
    """SC12/JO3: newest decisions with their analyst report period.

    Like the reference, every analyst_report row of a run joins (a run
    stored twice appears twice); ``limit`` is the listing size.
    """
    ra = artifacts.where(F.col("artifact_type") == "analyst_report").select(
        "run_id", F.get_json_object("artifact_json", "$.period_start").alias("period_start"),
        F.get_json_object("artifact_json", "$.period_end").alias("period_end"))
    d = decision_log.select("run_id", "as_of_date", "mode", "created_at")
    return d.join(ra, "run_id", "left") \
        .orderBy(F.col("created_at").desc(), F.col("run_id")).limit(limit)


def known_runs(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """SC13: requested run ids that have at least one artifact (semi join)."""
    return requests.join(artifacts.select("run_id"), "run_id", "left_semi")
