"""Tables that survive failed and repeated writes (SC4, SC6-SC9, SC14).

`VersionedTable`: a full refresh writes a new folder, and only then a pointer to it; readers
resolve the newest pointer, so a refresh that fails midway leaves the old table as it was.

`AppendLog`: an append writes its rows under (run, part, attempt) and then commits that attempt.
Readers see committed attempts only; the first commit of a (run, part) stands, so an append that is
retried, or whose writer died after writing, is there once, and another part adds to it.

Pointers and commits are small files created without overwriting through Hadoop's file systems,
as a creation that fails if the file exists; on stores without that, use one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillcycle.session import bounded_broadcast, shuffles_freed


class Folder:
    """A folder of small files in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def names(self) -> list[str]:
        if not self._fs.exists(self._root):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._root))

    def create(self, name: str, text: str) -> bool:
        """Writes the file; False if it is there already."""
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._pointers = Folder(spark, f"{self.path}/_pointers")

    def _versions(self) -> list[tuple[int, str]]:
        """(number, folder), oldest first; a pointer whose writer died before filling it counts as none."""
        found = [(int(n), self._pointers.read(n)) for n in self._pointers.names() if n.isdigit()]
        return [(n, folder) for n, folder in found if folder]

    def version(self) -> int | None:
        found = self._versions()
        return found[-1][0] if found else None

    def exists(self) -> bool:
        return self.version() is not None

    def refresh(self, df: DataFrame | Iterable[DataFrame], partition_by: tuple[str, ...] = ()) -> int:
        """Replaces the table by the rows of the frame, or of several, which are written one after
        another; returns the new version's number.  What a failed refresh wrote is removed."""
        folder = f"v-{uuid.uuid4().hex[:12]}"
        try:
            with shuffles_freed(self.spark):
                for part in [df] if isinstance(df, DataFrame) else df:
                    part.write.mode("append").partitionBy(*partition_by).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        except BaseException:
            Folder(self.spark, self.path).delete(folder)
            raise
        taken = [int(n) for n in self._pointers.names() if n.isdigit()]
        number = max(taken, default=0) + 1
        while not self._pointers.create(f"{number:012d}", folder):  # another refresh was first
            number += 1
        return number

    def read(self, version: int | None = None) -> DataFrame:
        found = dict(self._versions())
        if not found:
            raise FileNotFoundError(f"no version of {self.path}")
        return self.spark.read.parquet(f"{self.path}/{found[version if version is not None else max(found)]}")

    def drop_old(self, keep: int = 2) -> int:
        """Removes all but the newest ``keep`` versions, pointers first; returns how many."""
        old = self._versions()[:-keep] if keep else self._versions()
        data = Folder(self.spark, self.path)
        for number, folder in old:
            self._pointers.delete(f"{number:012d}")
            data.delete(folder)
        return len(old)


KEYS = ["_run", "_part", "_attempt"]


class AppendLog:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType):
        self.spark, self.path = spark, path.rstrip("/")
        own = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = own.names
        self._schema = StructType(list(own) + list(StructType.fromDDL(", ".join(f"{k} string" for k in KEYS))))
        self._commits = Folder(spark, f"{self.path}/_commits")

    def stage(self, df: DataFrame, run_id: str, part: str = "0", attempt: str | None = None) -> str:
        """Writes an attempt that nobody sees yet; returns its name."""
        attempt = attempt or uuid.uuid4().hex
        (df.select(*self.columns).withColumns({k: F.lit(v) for k, v in zip(KEYS, (run_id, part, attempt))})
         .write.mode("append").partitionBy(*KEYS).parquet(f"{self.path}/rows"))
        return attempt

    def commit(self, run_id: str, part: str, attempt: str) -> bool:
        """Makes the attempt the one of (run, part); False if another one is."""
        name = uuid.uuid5(uuid.NAMESPACE_OID, json.dumps([run_id, part])).hex + ".json"
        return self._commits.create(name, json.dumps(dict(zip(KEYS, (run_id, part, attempt)))))

    def append(self, df: DataFrame, run_id: str, part: str = "0") -> bool:
        """Appends the rows unless this (run, part) is there; False if it was."""
        if self.committed().where((F.col("_run") == run_id) & (F.col("_part") == part)).take(1):
            return False
        return self.commit(run_id, part, self.stage(df, run_id, part))

    def committed(self) -> DataFrame:
        """(_run, _part, _attempt) of all commits."""
        kind = ", ".join(f"{k} string" for k in KEYS)
        if not self._commits.names():
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).json(f"{self.path}/_commits").where("_attempt is not null")

    def read(self) -> DataFrame:
        """The rows of all committed attempts."""
        if not self._commits.names():
            return self.spark.createDataFrame([], self._schema).select(*self.columns)
        rows = self.spark.read.schema(self._schema).parquet(f"{self.path}/rows")
        return rows.join(bounded_broadcast(self.committed()), KEYS, "left_semi").select(*self.columns)
