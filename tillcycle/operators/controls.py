"""Deterministic control review of proposed actions (CR1-CR14, JO10, JO12, AG18).

``review_actions`` grades every action of every run with column
expressions only: each action row carries its run's ``control_profile``,
so any number of runs and actions are reviewed in one narrow projection
(no shuffle).  The rules are applied in the reference's order; a later
rule overwrites what an earlier one set.

Reasons are the report's sentences (one per rule that fired, in firing order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcycle.session import bounded_broadcast

# Control families per action type, risk ladder, and the
# policy controls cited for each action type (source document, control id).
FAMILY = {"restock": "inventory", "reorder": "inventory", "markdown": "pricing",
          "promo": "pricing", "staffing": "operations", "audit_returns": "quality",
          "other": "manual_review"}
RISK_ORDER = ["low", "medium", "high", "critical"]
POLICY_CITATIONS = [
    ("restock", "sop_restock_policy.md", "RESTOCK_APPROVAL"),
    ("restock", "sop_agent_change_control.md", "REG_INV_RELEASE"),
    ("reorder", "sop_restock_policy.md", "RESTOCK_APPROVAL"),
    ("reorder", "sop_agent_change_control.md", "REG_INV_RELEASE"),
    ("markdown", "sop_markdown_policy.md", "MARKDOWN_APPROVAL"),
    ("markdown", "sop_agent_change_control.md", "REG_PRICE_REVIEW"),
    ("promo", "sop_markdown_policy.md", "MARKDOWN_APPROVAL"),
    ("promo", "sop_agent_change_control.md", "REG_PRICE_REVIEW"),
    ("staffing", "sop_agent_change_control.md", "REG_STAFF_REVIEW"),
    ("audit_returns", "sop_agent_change_control.md", "REG_QA_ALLOWED"),
    ("other", "sop_agent_change_control.md", "REG_NON_STANDARD_BLOCK"),
]

# What each control says.
CONTROL_SUMMARIES = {
    "RESTOCK_APPROVAL": "Large replenishment orders require manager or director sign-off.",
    "REG_INV_RELEASE": "Only low-risk targeted inventory changes may auto-release.",
    "MARKDOWN_APPROVAL": "Customer-facing markdowns require approval based on discount tier.",
    "REG_PRICE_REVIEW": "Customer-facing price changes require human approval before release.",
    "REG_STAFF_REVIEW": "Staffing changes are operational changes and require human approval.",
    "REG_QA_ALLOWED": "Investigative quality checks may auto-release when targeted and low impact.",
    "REG_NON_STANDARD_BLOCK": "Non-standard actions are blocked until human review defines the procedure.",
}
# The sentence of each review rule.
INV_DIRECTOR = "Large inventory movement exceeds the director review threshold."
INV_WINDOW = "Inventory change exceeds the low-risk release window."
INV_LOW = "Targeted, low-volume inventory change is eligible for auto-release."
PRICE_HUMAN = "Customer-facing pricing changes require a human approval step."
PRICE_URGENT = "High-urgency pricing changes escalate to operations manager review."
STAFF_HUMAN = "Staffing changes are operational changes and require human review."
QUALITY_FREE = "Investigative quality checks may be released automatically."
OTHER_BLOCKED = "Non-standard action types are blocked until a human defines the procedure."
NO_TARGET = "Action lacks an explicit stock_code or category target."
REGULATED = "Regulated profile applies stricter release thresholds."
REG_INV_LOW = "Targeted inventory change remains within regulated low-risk limits."
REG_QUALITY = "Quality investigations remain executable but are tracked more closely."

HOLD, AUTO, BLOCKED = "hold_for_approval", "auto_release", "blocked"


def _family(t: Column) -> Column:
    expr = F.lit("manual_review")
    for typ, fam in reversed(list(FAMILY.items())):
        expr = F.when(t == typ, fam).otherwise(expr)
    return expr


def _raise(risk: Column) -> Column:
    return F.when(risk == "low", "medium").when(risk == "medium", "high").otherwise("critical")


def has_target(stock_code: Column, category: Column) -> Column:
    return (F.trim(F.coalesce(stock_code, F.lit(""))) != "") | \
        (F.trim(F.coalesce(category, F.lit(""))) != "")


def review_actions(actions: DataFrame, profile_col: str = "control_profile") -> DataFrame:
    """Adds control_family, risk_tier, approval_role, execution_state, reasons.

    ``actions`` needs action_type, stock_code, category, quantity, urgency
    and a profile column ('standard' / 'regulated').
    """
    t = F.col("action_type")
    fam = _family(t)
    qty = F.coalesce(F.col("quantity").cast("double"), F.lit(0.0))
    high = F.coalesce(F.col("urgency") == "high", F.lit(False))
    targeted = has_target(F.col("stock_code"), F.col("category"))
    inv = t.isin("restock", "reorder")
    pricing = t.isin("markdown", "promo")
    staffing = t == "staffing"
    quality = t == "audit_returns"
    big, mid = qty > 500, (qty > 100) | high

    # CR2-CR6: the per-family base grade
    risk = F.when(inv, F.when(big, "critical").when(mid, "high").otherwise("medium")) \
        .when(pricing | staffing, "high").when(quality, "low").otherwise("critical")
    role = F.when(inv, F.when(big, "director").when(mid, "operations_manager").otherwise("none")) \
        .when(pricing, F.when(high, "operations_manager").otherwise("category_manager")) \
        .when(staffing, "operations_manager").when(quality, "none") \
        .otherwise("manual_review_board")
    state = F.when(inv, F.when(big | mid, HOLD).otherwise(AUTO)) \
        .when(pricing | staffing, HOLD).when(quality, AUTO).otherwise(BLOCKED)
    r_base = F.when(inv, F.when(big, INV_DIRECTOR)
                    .when(mid, INV_WINDOW)
                    .otherwise(INV_LOW)) \
        .when(pricing, PRICE_HUMAN).when(staffing, STAFF_HUMAN) \
        .when(quality, QUALITY_FREE).otherwise(OTHER_BLOCKED)
    r_pricing_high = F.when(pricing & high, PRICE_URGENT)

    # CR7: targetable families without a target are blocked
    untargeted = fam.isin("inventory", "pricing", "quality") & ~targeted
    risk = F.when(untargeted, "critical").otherwise(risk)
    role = F.when(untargeted, "manual_review_board").otherwise(role)
    state = F.when(untargeted, BLOCKED).otherwise(state)
    r_target = F.when(untargeted, NO_TARGET)

    # CR8-CR11: the regulated profile
    reg = F.col(profile_col) == "regulated"
    risk = F.when(reg & fam.isin("inventory", "pricing", "operations"), _raise(risk)).otherwise(risk)
    r_reg = F.when(reg, REGULATED)
    inv_ok = inv & (qty <= 100) & ~high & targeted
    new_role = F.when(reg & (pricing | staffing) & (state != BLOCKED), "operations_manager") \
        .when(reg & inv_ok, "none") \
        .when(reg & inv & (state != BLOCKED),
              F.when(qty <= 500, "operations_manager").otherwise("director")) \
        .otherwise(role)
    new_state = F.when(reg & (pricing | staffing) & (state != BLOCKED), HOLD) \
        .when(reg & inv_ok, AUTO) \
        .when(reg & inv & (state != BLOCKED), HOLD) \
        .otherwise(state)
    r_inv_ok = F.when(reg & inv_ok, REG_INV_LOW)
    q_reg = reg & quality & (state != BLOCKED)
    risk = F.when(q_reg, "medium").otherwise(risk)
    r_quality = F.when(q_reg, REG_QUALITY)

    # joined lists, not a filtered one: a function over list elements would keep the whole
    # projection from being compiled
    reasons = F.concat(*[F.when(r.isNull(), F.array().cast("array<string>")).otherwise(F.array(r))
                         for r in (r_base, r_pricing_high, r_target, r_reg, r_inv_ok, r_quality)])
    return actions.select(
        "*", fam.alias("control_family"), risk.alias("risk_tier"),
        new_role.alias("approval_role"), new_state.alias("execution_state"),
        reasons.alias("reasons"))


def policy_table(spark) -> DataFrame:
    """JO10 lookup: action_type -> ordered citations (7 rows, fixed)."""
    rows = {}
    for typ, src, cid in POLICY_CITATIONS:
        rows.setdefault(typ, []).append((src, cid))
    data = [(t, [{"source": s, "control_id": c, "summary": CONTROL_SUMMARIES[c]} for s, c in cites])
            for t, cites in rows.items()]
    return spark.createDataFrame(
        data, "policy_type string, citations array<struct<source:string,control_id:string,summary:string>>")


def with_citations(reviews: DataFrame) -> DataFrame:
    """Attach citations; unknown action types use the 'other' entry.

    The policy table has one row per action type (a fixed size), so it is
    broadcast; the lookup key is normalised first so the join stays equi.
    """
    pol = F.broadcast(policy_table(reviews.sparkSession))
    key = F.when(F.col("action_type").isin(list(FAMILY)), F.col("action_type")).otherwise("other")
    return reviews.withColumn("policy_type", key) \
        .join(pol, "policy_type", "left").drop("policy_type")


def review_summary(reviews: DataFrame, runs: DataFrame) -> DataFrame:
    """AG18/CR13 per run (runs without actions included, all counts 0).

    Output: run_id, control_profile, auto_release, held, blocked,
    overall_state, requires_human_approval, summary.
    """
    st = F.col("execution_state")
    agg = reviews.groupBy("run_id").agg(
        F.count_if(st == AUTO).alias("auto_release"),
        F.count_if(st == HOLD).alias("held"),
        F.count_if(st == BLOCKED).alias("blocked"))
    j = runs.select("run_id", "control_profile").join(agg, "run_id", "left").na.fill(
        0, ["auto_release", "held", "blocked"])
    overall = F.when(F.col("blocked") > 0, "blocked") \
        .when(F.col("held") > 0, "approval_required").otherwise("auto_release")
    # Fixed value: the summary sentence format of the control report.
    summary = F.format_string(
        "Control profile '%s' released %d action(s), held %d for approval, "
        "and blocked %d for manual review.",
        F.col("control_profile"), F.col("auto_release"), F.col("held"), F.col("blocked"))
    return j.select("run_id", "control_profile", "auto_release", "held", "blocked",
                    overall.alias("overall_state"),
                    (F.col("held") > 0).alias("requires_human_approval"),
                    summary.alias("summary"))


def executable(actions: DataFrame, reviews: DataFrame | None) -> DataFrame:
    """JO12/CR14: actions that may run now — the auto-released ones, or all
    actions of a run that has no review at all.

    The reviews themselves as ``actions`` (the same frame: each row is an
    action with its own review) are filtered where they are, without a join."""
    if reviews is None:
        return actions
    if reviews is actions:
        return actions.where(F.col("execution_state") == AUTO).drop("execution_state")
    # the keys' hash comes first: sorting by a long is faster than by texts that begin alike
    keys = ["_h", "run_id", "action_id"]
    hashed = lambda df: df.withColumn("_h", F.xxhash64("run_id", "action_id"))
    rv = hashed(reviews).select(*keys, "execution_state")
    # one row per run: without the bound a run with most of the actions would be one key
    reviewed_runs = bounded_broadcast(reviews.select("run_id").distinct().withColumn("_reviewed", F.lit(True)))
    a = hashed(actions).join(rv, keys, "left").drop("_h").join(reviewed_runs, "run_id", "left")
    keep = (F.col("execution_state") == AUTO) | F.col("_reviewed").isNull()
    return a.where(keep).drop("execution_state", "_reviewed")
