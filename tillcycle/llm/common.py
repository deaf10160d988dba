"""Helpers shared by the operators: the shared folder, written tables, text constants."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).  A folder of
    our own is used only where the session names none, as in tests on one machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        current = sc._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        path = tempfile.mkdtemp(prefix="llm-shared-")
        sc.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost
    executors, and is read column by column.  The folder is the session's scratch space."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def column(name: str) -> Column:
    """The column of exactly this name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [column(n) for n in df.columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it (upper or lower case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hashes(docs: DataFrame) -> tuple[Column, Column]:
    """128 bits of all columns of a row, as two longs; nulls count by their place, maps and
    variants by their JSON text."""
    def cell(name: str, kind: str) -> Column:
        return F.to_json(F.struct(column(name))) if "map<" in kind or "variant" in kind else column(name)

    cells = [c for n, kind in docs.dtypes for c in (column(n).isNull(), cell(n, kind))]
    return F.xxhash64(F.lit(1), *cells), F.xxhash64(F.lit(2), *cells)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
