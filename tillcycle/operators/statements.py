"""FI1 + PR14: parameterised SQL statements that see bounded relations only.

Statements run in a session of their own, whose only relations are temporary views over the
given frames, cut at ``as_of`` (all rows in omniscient mode).  Values come in as named arguments;
``:as_of`` and ``:start`` are always there.  A statement must be a query, and its analysed plan
may read nothing but the views: tables of the shared catalog, files named in the text and
commands are refused before anything runs.  Results are written once; the evidence (statement,
arguments, preview, row count, fingerprint) is computed from what was written.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from tillcycle.operators.asof import as_of_view
from tillcycle.operators.report import evidence
from tillcycle.params import as_date
from tillcycle.session import cut_lineage

#: Plan nodes without rows of any table.
HARMLESS = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"}
NO_QUERY = ("org.apache.spark.sql.catalyst.plans.logical.Command",
            "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")


class StatementRefused(ValueError):
    """The statement is no query, or reads something else than the views."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def foreign_relations(plan, allowed: set[str]) -> list[str]:
    """What a plan (a JVM object) reads beside the views named in ``allowed``."""
    kind = plan.nodeName()
    if kind == "View":
        name = plan.desc().identifier().table()
        if plan.isTempView() and name in allowed:
            return []
    parts = _items(plan.children()) + _items(plan.subqueries())
    if not _items(plan.children()) and kind not in HARMLESS:
        return [plan.simpleString(20)]
    return [x for p in parts for x in foreign_relations(p, allowed)]


class Statements:
    """``relations``: name -> (a function of the session that builds the frame, its date column
    or None for relations without a time)."""

    def __init__(self, spark: SparkSession, relations: Mapping[str, tuple[Callable[[SparkSession], DataFrame], str | None]],
                 as_of, start=None, mode: str = "bounded", end_of_day: bool = False):
        self.session = spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.timestampType"):
            self.session.conf.set(key, spark.conf.get(key))
        self.names, self.mode = set(relations), mode
        self.args: dict[str, Any] = {"as_of": as_date(as_of)}
        if start is not None:
            self.args["start"] = as_date(start)
        for name, (build, date_col) in relations.items():
            frame = build(self.session)
            if date_col:
                frame = as_of_view(frame, as_of, mode, end_of_day, date_col)
            frame.createOrReplaceTempView(name)

    def _no_query(self, plan) -> bool:
        loader = self.session._jvm.java.lang.Thread.currentThread().getContextClassLoader()
        return any(loader.loadClass(c).isInstance(plan) for c in NO_QUERY)

    def query(self, sql: str, args: Mapping[str, Any] | None = None) -> DataFrame:
        """The statement's rows, not yet computed."""
        try:
            # parsed before it is handed on: commands would run at once
            if self._no_query(self.session._jsparkSession.sessionState().sqlParser().parsePlan(sql)):
                raise StatementRefused("not a query")
            clash = sorted(set(args or {}) & set(self.args))
            if clash:
                raise StatementRefused(f"arguments fixed by the run: {clash}")
            df = self.session.sql(sql, args=self.args | dict(args or {}))
        except ParseException as e:
            raise StatementRefused(f"not a statement: {e.getMessage()}") from e
        except AnalysisException as e:
            raise StatementRefused(f"not answerable from {sorted(self.names)}: {e.getMessage()}") from e
        foreign = foreign_relations(df._jdf.queryExecution().analyzed(), self.names)
        if foreign:
            raise StatementRefused(f"reads {foreign} beside {sorted(self.names)}")
        return df

    def run(self, step: str, sql: str, args: Mapping[str, Any] | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows, evidence), both of one run."""
        rows = cut_lineage(self.query(sql, args))
        said = [f"{k}={v}" for k, v in sorted((self.args | dict(args or {})).items())]
        return rows, evidence(rows, step, [f"mode={self.mode}", *said], sql, stored=True)
