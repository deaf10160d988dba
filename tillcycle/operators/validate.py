"""Record coercion and validation as rule columns (PR9, PR10, FI8).

Validation never raises per record: each rule is a boolean column, and a
frame splits into (valid, quarantine) with the names of the failed rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcycle.operators.controls import FAMILY

# Allowed enumerations of the typed records.
ACTION_TYPES = list(FAMILY)
URGENCIES = ["low", "medium", "high"]
MODES = ["bounded", "omniscient"]
PROFILES = ["standard", "regulated"]
PRIORITIES = ["low", "medium", "high"]


def coerce_actions(df: DataFrame) -> DataFrame:
    """PR9: quantity to double or NULL when not numeric; NULL text to ''
    for description / expected_impact; urgency defaults to 'medium'."""
    out = df.withColumn("quantity", F.col("quantity").cast("string").try_cast("double"))
    for c in ("description", "expected_impact"):
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out.withColumn("urgency", F.coalesce(F.col("urgency"), F.lit("medium")))


def validate(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split on named boolean rules (NULL counts as a failure).

    Returns (valid rows, quarantined rows with ``failed_rules``).
    """
    failed = F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n))
                                for n, r in rules.items()]), lambda x: x.isNotNull())
    tagged = df.withColumn("failed_rules", failed)
    ok = F.size("failed_rules") == 0
    return tagged.where(ok).drop("failed_rules"), tagged.where(~ok)


def action_rules() -> dict[str, Column]:
    return {
        "action_type_known": F.col("action_type").isin(ACTION_TYPES),
        "urgency_known": F.col("urgency").isin(URGENCIES),
        "description_present": F.col("description").isNotNull(),
    }


def decision_rules() -> dict[str, Column]:
    return {
        "confidence_in_range": F.col("confidence").between(0.0, 1.0),
        "mode_known": F.col("mode").isin(MODES),
    }


def run_request_rules(span_min: Column, span_max: Column) -> dict[str, Column]:
    """FI8: start before as_of, both inside the data span."""
    return {
        "start_before_as_of": F.col("start_date") < F.col("as_of_date"),
        "start_in_span": F.col("start_date").between(span_min, span_max),
        "as_of_in_span": F.col("as_of_date").between(span_min, span_max),
        "mode_known": F.col("mode").isin(MODES),
        "profile_known": F.col("control_profile").isin(PROFILES),
    }


def validate_requests(requests: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FI8 over a table of run requests.  The data span is two scalars
    (one aggregate job), used as literals in the rules."""
    lo, hi = facts.agg(F.to_date(F.min("invoice_date")), F.to_date(F.max("invoice_date"))).first()
    return validate(requests, run_request_rules(F.lit(lo), F.lit(hi)))
