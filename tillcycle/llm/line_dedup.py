"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

The key of a line is the line with white space at both ends stripped and A-Z lower-cased;
keys of at least ``min_chars`` code points are tracked, by a 128-bit hash.  The state is a
folder in shared storage.  Every change writes a generation, a folder of its own with

* postings  (k1, k2, doc_id): the keys that the documents inserted hold;
* gone      (doc_id): the documents deleted;
* refs      (shard, k1, k2, refs, keeper, step): the exact number of documents and the largest
  doc_id of the keys that the change touched, and no others; step: 1, the key is new, -1, it is gone;
* filters   (shard, filter): the cuckoo filters of the shards whose set of keys changed;

and last a small file that names the folders which make up the state, so a change that fails
midway, or is run again by a lost executor, leaves the state as it was; a new session opens
the newest.  A key's counts are those of its newest generation.

``insert`` counts a batch per key and reads the filters of its shards, alone: keys that a
filter does not hold are surely new and are appended; only the others are looked up in the
exact counts, of the shards that have such keys.  ``delete`` lowers the counts of the keys of
the documents taken back; only where the keeper goes, the other holders are read for the next
largest doc_id; a key that no document holds leaves the filter.  So a delete undoes an insert.
``compact`` folds all generations into one, with more shards if there are too many keys for
them; ``insert`` does so by itself after ``MAX_GENERATIONS`` or if a shard would hold more than
``keys_per_shard`` keys.

A shard's changed keys and its filter are processed together; shards are set from the first
batch, with room for three more of its size.  Keys are pre-aggregated before they meet, so a line of a third
of all documents is one row per task, and salted where they meet their documents again.
The driver holds the numbers of the touched shards, a few bytes for ``keys_per_shard`` keys.

Defined cases: a null or empty text is one empty line; rows with the same doc_id are one
document; a null doc_id is a document of its own, never the keeper while another is; an
empty batch changes nothing; ids to delete that are not there are passed over; a batch whose
name is in the state is not inserted again.  Documents inserted must not be in the state already.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tillcycle.llm.common import columns, shared_dir, unused
from tillcycle.llm.cuckoo import CuckooFilter
from tillcycle.sources.stored import Folder

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS, KEYS_PER_SHARD, MAX_GENERATIONS = 20, 3, 200_000, 16
LEAST_SHARDS, ROOM, SALTS, BATCHES = 8, 4, 16, 2
_KINDS = {"postings": "k1 long, k2 long, doc_id long", "gone": "doc_id long",
          "refs": "k1 long, k2 long, refs long, keeper long, step int, shard int",
          "filters": "filter binary, shard int"}
_KEY = ["shard", "k1", "k2"]
_ASKED = "shard int, k1 long, k2 long, refs long, keeper long, maybe boolean"


def line_key(line: str, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key; None if the key is too short to be tracked."""
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    return hashlib.blake2b(key.encode().lower(), digest_size=16).digest()


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, doc_id): each key that a row's text holds, once."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                keys = {line_key(x, min_chars) for x in (text or "").split("\n")} - {None}
                found += keys
                owner += [i] * len(keys)
            both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column(0).take(pa.array(owner, pa.int64()))],
                names=["k1", "k2", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, _KINDS["postings"])


def _longs(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows[n].to_numpy().astype(np.int64) for n in names]


def _ask(change: pa.Table, held: pa.Table) -> pa.Table:
    """The shard's changed keys, and whether its filter may hold them."""
    if not held.num_rows:
        maybe = np.zeros(change.num_rows, bool)
    elif held["filter"][0].as_py() is None:  # none could be kept: the counts decide alone
        maybe = np.ones(change.num_rows, bool)
    else:
        maybe = CuckooFilter.loads(held["filter"][0].as_py()).contains(*_longs(change, "k1", "k2"))
    return change.append_column("maybe", pa.array(maybe, pa.bool_()))


def _refilter(capacity: int):
    """The shard's filter with the new keys and without those gone; null if one finds no place."""
    def run(key, change: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if change.num_rows:
            data = held["filter"][0].as_py() if held.num_rows else CuckooFilter.sized(capacity).dumps()
            if data is not None:
                (step,) = _longs(change, "step")
                k1, k2 = _longs(change, "k1", "k2")
                filt = CuckooFilter.loads(data)
                filt.delete(k1[step < 0], k2[step < 0])
                data = filt.dumps() if filt.add(k1[step > 0], k2[step > 0]) else None
            out.append(data)
        return pa.table({"filter": pa.array(out, pa.binary()), "shard": pa.array([key[0].as_py()] * len(out), pa.int32())})
    return run


class LineDedup:
    """The state in ``path``: that of its newest generation, or a new one (in a new folder of
    the shared one if no path is given)."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int | None = None,
                 min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD):
        self.spark, self.keys_per_shard = spark, keys_per_shard
        self.path = path or f"{shared_dir(spark).rstrip('/')}/llm-lines-{uuid.uuid4().hex[:12]}"
        self._log = Folder(spark, f"{self.path}/_generations")
        #: folders: (generation, folder) of each kind of table; keys: live keys
        self.made = {"generation": 0, "shards": shards, "keys": 0, "min_chars": min_chars, "batches": [],
                     "capacity": keys_per_shard * 5 // 4, "folders": {k: [] for k in _KINDS}}
        for name in sorted((n for n in self._log.names() if n.isdigit()), reverse=True):
            text = self._log.read(name)
            if text:  # empty: its writer died before filling it
                self.made = json.loads(text)
                if self.made["min_chars"] != min_chars:
                    raise ValueError(f"the state tracks keys of {self.made['min_chars']} code points, not {min_chars}")
                break

    @property
    def shards(self) -> int:
        return self.made["shards"]

    # -- reading -------------------------------------------------------------------------

    def _read(self, kind: str, touched: list[int] | None = None) -> DataFrame:
        """The rows of all generations with their number ``gen``, of the touched shards only if given."""
        def one(gen: int, folder: str) -> DataFrame:
            df = self.spark.read.schema(_KINDS[kind]).parquet(f"{self.path}/{folder}/{kind}")
            if touched is not None and len(touched) < self.shards:
                df = df.where(F.col("shard").isin(touched))  # a folder a shard: the others are not opened
            return df.withColumn("gen", F.lit(gen))
        parts = [one(*f) for f in self.made["folders"][kind]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], _KINDS[kind] + ", gen int")

    def _newest(self, kind: str, by: list[str], touched: list[int] | None = None,
                only: DataFrame | None = None) -> DataFrame:
        rows = self._read(kind, touched)
        if only is not None:
            rows = rows.join(only, by, "left_semi")
        if len(self.made["folders"][kind]) < 2:
            return rows.drop("gen")
        rest = [c for c in rows.columns if c not in (*by, "gen")]
        return (rows.groupBy(*by).agg(F.max_by(F.struct(*rest), "gen").alias("newest"))
                .select(*by, "newest.*"))

    @property
    def refs(self) -> DataFrame:
        """(shard, k1, k2, refs, keeper) of the keys that a document holds."""
        return self._newest("refs", _KEY).where("refs > 0").select(*_KEY, "refs", "keeper")

    @property
    def filters(self) -> DataFrame:
        return self._newest("filters", ["shard"]).select("shard", "filter")

    def postings(self) -> DataFrame:
        """(k1, k2, doc_id) of the documents in the state."""
        held = self._read("postings")
        if self.made["folders"]["gone"]:
            gone = self._read("gone").groupBy(F.col("doc_id").alias("gone")).agg(F.max("gen").alias("until"))
            held = held.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("gen") < F.col("until")), "left_anti")
        return held.select("k1", "k2", "doc_id")

    @staticmethod
    def _holders(held: DataFrame, keys: DataFrame) -> DataFrame:
        """The postings of the keys (k1, k2, ...), each key once.  Salted: a key may be in a third of all documents."""
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
        spread = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        return held.select("*", salt).join(spread, ["k1", "k2", "salt"]).drop("salt")

    # -- writing -------------------------------------------------------------------------

    def _shard(self, shards: int | None = None):
        return F.pmod(F.col("k1"), F.lit(shards or self.shards)).cast("int").alias("shard")

    def _write(self, df: DataFrame, kind: str, folder: str) -> DataFrame:
        at = f"{self.path}/{folder}/{kind}"
        own = [c.split()[0] for c in _KINDS[kind].split(", ")]
        writer = df.select(*own).write.option("compression", "zstd")
        (writer.partitionBy("shard") if "shard" in own else writer).parquet(at)
        return self.spark.read.schema(_KINDS[kind]).parquet(at)

    def _commit(self, made: dict, folder: str, kinds: list[str]) -> None:
        made["generation"] = n = self.made["generation"] + 1
        for kind in kinds:
            made["folders"][kind].append([n, folder])
        while not self._log.create(f"{n:012d}", json.dumps(made)):
            if self._log.read(f"{n:012d}"):
                raise RuntimeError(f"{self.path}: another change became generation {n} first")
            self._log.delete(f"{n:012d}")  # its writer died before filling it
        self.made = made

    @staticmethod
    def _touched(df: DataFrame) -> list[int]:
        return sorted(r[0] for r in df.select("shard").distinct().collect())

    def _change(self, change: DataFrame, folder: str, kinds: list[str], **more) -> None:
        """change: (shard, k1, k2, refs, keeper, step), refs and keeper being the new ones."""
        made = json.loads(json.dumps(self.made | more))
        refs = self._write(change, "refs", folder)
        steps = refs.where("step <> 0").select("shard", "k1", "k2", "step")
        held = self._newest("filters", ["shard"], self._touched(steps))
        self._write(steps.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(
            _refilter(made["capacity"]), _KINDS["filters"]), "filters", folder)
        made["keys"] += steps.agg(F.sum("step")).first()[0] or 0
        self._commit(made, folder, [*kinds, "refs", "filters"])

    def _asked(self, change: DataFrame, part: DataFrame) -> DataFrame:
        """(shard, k1, k2, refs, keeper, maybe) of the batch, from the filters of its shards alone."""
        held = self._newest("filters", ["shard"], self._touched(part.select(self._shard())))
        return change.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(_ask, _ASKED)

    def insert(self, docs: DataFrame, batch: str | None = None) -> LineDedup:
        """Adds the documents; a batch of a name that is in the state already is passed over."""
        if batch is not None and batch in self.made["batches"]:
            return self
        folder = f"g-{uuid.uuid4().hex[:12]}"
        part = self._write(postings(docs, self.made["min_chars"]), "postings", folder)
        most = self.made["keys"] + part.count()
        need = max(LEAST_SHARDS, -(-ROOM * most // self.keys_per_shard))
        if self.shards is None:
            self.made["shards"] = need
        elif most > self.shards * self.keys_per_shard or len(self.made["folders"]["refs"]) >= MAX_GENERATIONS:
            self.compact(max(need, self.shards) if most > self.shards * self.keys_per_shard else self.shards)
        change = part.groupBy("k1", "k2").agg(F.count_distinct(F.struct("doc_id")).alias("refs"),
                                              F.max("doc_id").alias("keeper")).select(self._shard(), "*")
        if self.made["folders"]["refs"]:
            at = f"{self.path}/{folder}/asked"
            self._asked(change, part).write.option("compression", "zstd").parquet(at)
            asked = self.spark.read.schema(_ASKED).parquet(at)
            known = asked.where("maybe")
            old = self._newest("refs", _KEY, self._touched(known), known.select(*_KEY)).where("refs > 0").select(
                *_KEY, F.col("refs").alias("had"), F.col("keeper").alias("kept"))
            change = known.join(old, _KEY, "left").select(
                *_KEY, (F.coalesce("had", F.lit(0)) + F.col("refs")).alias("refs"),
                F.greatest("keeper", "kept").alias("keeper"), F.when(F.col("had").isNull(), 1).otherwise(0).alias("step"))
            change = change.unionByName(asked.where("not maybe").select(*_KEY, "refs", "keeper", F.lit(1).alias("step")))
        else:
            change = change.withColumn("step", F.lit(1))
        # one task writes a shard, and a shard is one file
        self._change(change.repartition("shard"), folder, ["postings"],
                     batches=self.made["batches"] + ([batch] if batch is not None else []))
        return self

    def delete(self, ids: DataFrame) -> LineDedup:
        """Takes the documents of the ``doc_id`` column out of the state."""
        if not self.made["folders"]["refs"]:
            return self
        folder = f"g-{uuid.uuid4().hex[:12]}"
        gone = self._write(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "gone", folder)
        gone = gone.select(F.col("doc_id").alias("gone"))
        held, hit = self.postings(), F.col("doc_id").eqNullSafe(F.col("gone"))
        lost = held.join(gone, hit, "left_semi").groupBy("k1", "k2").agg(
            F.count_distinct(F.struct("doc_id")).alias("lost")).select(self._shard(), "*")
        at = f"{self.path}/{folder}/lost"
        lost.write.option("compression", "zstd").parquet(at)
        lost = self.spark.read.schema("shard int, k1 long, k2 long, lost long").parquet(at)
        now = (self._newest("refs", _KEY, self._touched(lost), lost.select(*_KEY)).join(lost, _KEY)
               .join(gone, F.col("keeper") == F.col("gone"), "left")
               .select(*_KEY, (F.col("refs") - F.col("lost")).alias("refs"), "keeper",
                       F.col("gone").isNotNull().alias("orphan")))
        left = self._holders(held.join(gone, hit, "left_anti"), now.where("orphan and refs > 0").select("k1", "k2"))
        heirs = left.groupBy("k1", "k2").agg(F.max("doc_id").alias("heir"))
        change = now.join(heirs, ["k1", "k2"], "left").select(
            *_KEY, "refs", F.when(F.col("orphan"), F.col("heir")).otherwise(F.col("keeper")).alias("keeper"),
            F.when(F.col("refs") == 0, -1).otherwise(0).alias("step"))
        self._change(change.repartition("shard"), folder, ["gone"])
        return self

    def compact(self, shards: int | None = None) -> LineDedup:
        """All generations as one, in ``shards`` shards; the state stays what it was."""
        if not self.made["folders"]["refs"]:
            return self
        folder, shards = f"g-{uuid.uuid4().hex[:12]}", shards or self.shards
        made = json.loads(json.dumps(self.made | {"shards": shards, "capacity": self.keys_per_shard * 5 // 4}))
        kinds = ["refs", "filters"]
        if len(made["folders"]["postings"]) > 1 or made["folders"]["gone"]:
            self._write(self.postings(), "postings", folder)
            kinds.append("postings")
            made["folders"] |= {"postings": [], "gone": []}
        live = self.refs.drop("shard").select(self._shard(shards), "*", F.lit(1).alias("step"))
        refs = self._write(live.repartition("shard"), "refs", folder)
        none = self.spark.createDataFrame([], _KINDS["filters"])
        self._write(refs.groupBy("shard").cogroup(none.groupBy("shard")).applyInArrow(
            _refilter(made["capacity"]), _KINDS["filters"]), "filters", folder)
        made["folders"] |= {"refs": [], "filters": []}
        self._commit(made, folder, kinds)
        return self

    # -- using ---------------------------------------------------------------------------

    def drops(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(doc_id, drop): 16-byte keys whose lines the document loses."""
        often = self.refs.where(F.col("refs") >= min_docs).select("k1", "k2", "keeper")
        return (self._holders(self.postings(), often)
                .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
                .groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("drop")))

    def clean(self, docs: DataFrame, min_docs: int = MIN_DOCS,
              added: tuple[str, ...] = ("kept_text", "n_lines", "n_dropped")) -> DataFrame:
        """The rows of ``docs`` with the text kept, the number of lines and of those dropped, in
        columns named ``added``, which replace columns of these names."""
        docs = docs.drop(*added)
        own_id, own_drop = unused(docs, "own_id", "own_drop")
        drops = self.drops(min_docs).select(F.col("doc_id").alias(own_id), F.col("drop").alias(own_drop))
        both = docs.join(drops, docs["doc_id"].cast("long").eqNullSafe(drops[own_id]), "left")
        names, min_chars = docs.columns, self.made["min_chars"]
        text_at = names.index("text")

        def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept, lines_of, dropped = [], [], []
                for text, drop in zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist(),
                                      strict=True):
                    lines = (text or "").split("\n")
                    lines_of.append(len(lines))
                    if drop:
                        out = {np.array([d["k1"], d["k2"]], "<i8").tobytes() for d in drop}
                        stay = [x for x in lines if line_key(x, min_chars) not in out]
                        dropped.append(len(lines) - len(stay))
                        text = "\n".join(stay)
                    else:
                        dropped.append(0)
                    kept.append(text)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in range(len(names))], pa.array(kept, pa.string()),
                     pa.array(lines_of, pa.int64()), pa.array(dropped, pa.int64())],
                    names=[*own, "kept", "lines", "dropped"])

        # numbered inside the task: mapInArrow takes no names with dots or back-ticks
        own = [f"c{i}" for i in range(len(names))]
        schema = StructType([StructField(c, f.dataType) for c, f in zip(own, docs.schema, strict=True)])
        for name, kind in zip(("kept", "lines", "dropped"), ("string", "long", "long"), strict=True):
            schema.add(name, kind)
        return (both.select(*[c.alias(o) for c, o in zip(columns(docs), own, strict=True)], own_drop)
                .mapInArrow(rebuild, schema).toDF(*names, *added))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES,
          **kw) -> DataFrame:
    """The documents cleaned by a new state that takes them in ``batches``, as a corpus arrives in
    parts: from the second on, the filters tell which keys the exact counts are read for.
    Rows are dealt by doc_id, so that rows of one document are in one batch."""
    state = LineDedup(docs.sparkSession, min_chars=min_chars)
    batch = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(batches))
    for i in range(batches):
        state.insert(docs.where(batch == i))
    return state.clean(docs, min_docs, **kw)


SQL = r"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM raw),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
