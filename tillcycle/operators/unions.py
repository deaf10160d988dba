"""PR9: fields of more than one type, read from VARIANT columns.

A record's JSON is parsed once (``try_parse_json``: text that is no JSON gives null); each field is
then taken by what it turns out to be: a number or a numeric text, a list or a single text,
anything as text.  Nothing raises; what fits no reading is null, empty or the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcycle.operators.audit import FINDING_TYPES


def number(v: Column, path: str) -> Column:
    """A number, or a text that holds one; else null."""
    return F.try_variant_get(v, path, "string").try_cast("double")


def text(v: Column, path: str) -> Column:
    """Numbers and booleans as text; null as ''."""
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def strings(v: Column, path: str) -> Column:
    """A list as it is (elements as text), a single text as a list of one, null as an empty list."""
    one = F.try_variant_get(v, path, "string")
    return F.coalesce(F.try_variant_get(v, path, "array<string>"), F.when(one.isNotNull(), F.array(one)),
                      F.array().cast("array<string>"))


def one_of(v: Column, path: str, allowed: list[str], default: str) -> Column:
    """The text if it is allowed, else the default."""
    found = F.try_variant_get(v, path, "string")
    return F.when(found.isin(allowed), found).otherwise(F.lit(default))


def union_records(df: DataFrame, json_col: str = "payload_json") -> DataFrame:
    """Adds quantity, acceptance_criteria, finding_type and reported_value, and drops the JSON."""
    v = F.col("_v")
    return df.withColumn("_v", F.try_parse_json(F.col(json_col))).withColumns({
        "quantity": number(v, "$.quantity"), "acceptance_criteria": strings(v, "$.acceptance_criteria"),
        "finding_type": one_of(v, "$.finding_type", FINDING_TYPES, "other"),
        "reported_value": text(v, "$.reported_value")}).drop("_v", json_col)
