"""A user's own function over the days of one key, for all keys at once.

The function sees one key's rows as a pandas frame, in the order of ``order_by``, and returns
rows of a declared schema.  A key's rows are a calendar, bounded by days and not by sales; a
key above ``max_rows`` is refused by name, by a count, before any group is gathered.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillcycle.operators.demand import key_list

#: Ten years of days.
MAX_ROWS = 3653
KEYS_PER_TASK = 64


class GroupTooLarge(ValueError):
    """A key has more rows than one task may hold."""


def _checked(frame: DataFrame, ks: list[str], max_rows: int) -> int:
    """The number of keys; raises where one is above ``max_rows``."""
    sizes = frame.groupBy(*ks).agg(F.count(F.lit(1)).alias("n"))
    n, most = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    if (most or 0) > max_rows:
        large = sizes.orderBy(F.desc("n"), *ks).limit(5).collect()
        raise GroupTooLarge(f"more than {max_rows} rows: " + ", ".join(
            "/".join(str(r[k]) for k in ks) + f" ({r['n']})" for r in large))
    return n


def _tasks(frame: DataFrame, keys: int) -> int:
    """Small groups can be much work: a task takes one key while there are cores to spare, and
    ``KEYS_PER_TASK`` at most."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return max(1, min(keys, 4 * cores), -(-keys // KEYS_PER_TASK))


def _result_schema(frame: DataFrame, ks: list[str], schema: str | StructType) -> StructType:
    own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    clash = sorted(set(ks) & set(own.names))
    if clash:
        raise ValueError(f"the result's schema repeats key columns: {clash}")
    return StructType([frame.schema[k] for k in ks] + list(own))


def _keyed(out: pd.DataFrame, names: list[str], ks: list[str], key: tuple) -> pd.DataFrame:
    missing = [c for c in names if c not in ks and c not in out.columns]
    if missing:
        raise ValueError(f"the function returned no {missing}")
    for k, v in zip(ks, key):
        out = out.assign(**{k: v})
    return out[names]


def apply_per_key(frame: DataFrame, key, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType,
                  order_by: str = "ds", max_rows: int = MAX_ROWS) -> DataFrame:
    """*key and the columns of ``schema`` of ``fn`` for each key.  ``frame`` is read twice (the
    count, the groups), so it should be a table or cheap."""
    ks = key_list(key)
    tasks = _tasks(frame, _checked(frame, ks, max_rows))
    result = _result_schema(frame, ks, schema)

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _keyed(fn(rows.sort_values(order_by, ignore_index=True)), result.names, ks, group)

    return frame.repartition(tasks, *ks).groupBy(*ks).applyInPandas(run, result)


def apply_per_key_with(frame: DataFrame, other: DataFrame, key, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
                       schema: str | StructType, order_by: str = "ds", max_rows: int = MAX_ROWS) -> DataFrame:
    """As `apply_per_key`, with the same key's rows of ``other`` (a stored model, say) as the
    function's second argument.  Keys that only one of the two has are left out."""
    ks = key_list(key)
    tasks = _tasks(frame, max(_checked(frame, ks, max_rows), _checked(other, ks, max_rows)))
    result = _result_schema(frame, ks, schema)

    def run(group: tuple, rows: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or more.empty:
            return pd.DataFrame({c: [] for c in result.names})
        return _keyed(fn(rows.sort_values(order_by, ignore_index=True), more), result.names, ks, group)

    sides = (x.repartition(tasks, *ks).groupBy(*ks) for x in (frame, other))
    return next(sides).cogroup(next(sides)).applyInPandas(run, result)
