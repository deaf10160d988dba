"""Chat formatting of reply trees.

Messages (tree, node, parent, role, text, score) form trees.  Iterative self-joins on
(tree, ancestor) double the distance looked back in every round, so a tree of any depth d
takes log2(d) rounds: first the total score of every root-to-leaf path, which ranks the
branches of a tree, then, for the chosen leaves only, the messages of their paths.  Each path
is formatted as one conversation:

    [INST]role:text[/INST]     a turn of any role but the assistant
    <s>text</s>                a turn of the assistant, under the loss mask

Control strings inside a text get a backslash after their first character, and one more where
backslashes stand there already, so `parse` gets every text back.  Roles are percent-encoded.

Defined cases: null text and role are empty; a null or unknown parent makes a root; messages on
a cycle reach no root and are in no path; null score counts 0; ties in score go to the smaller
leaf; several rows of one (tree, node) are taken as the one that is least by (role, text);
a null tree is a tree of its own.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillcycle.llm.common import written

ASSISTANT = "assistant"
_ESCAPE = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")
_UNESCAPE = re.compile(r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\])")
_TURN = re.compile(r"\[INST\]([^:]*):(.*?)\[/INST\]|<s>(.*?)</s>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"{m[1] or m[4]}\\{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: f"{m[1] or m[4]}{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and its loss spans, in code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == ASSISTANT:
            spans.append((at + 3, at + 3 + len(body)))
            piece = f"<s>{body}</s>"
        else:
            piece = f"[INST]{quote(role, safe='')}:{body}[/INST]"
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(ASSISTANT, unescape(m[3])) if m[3] is not None else (unquote(m[1]), unescape(m[2]))
            for m in _TURN.finditer(formatted)]


def _paths(messages: DataFrame, top: int) -> DataFrame:
    """(tree, leaf, rank, score, hops, node): the messages of the chosen paths, hops before the
    leaf."""
    m = written(messages.select("tree", "node", "parent", "score"), "nodes")
    key = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    there = m.select("tree", F.col("node").alias("up"))
    own = F.coalesce(F.col("m.score").cast("double"), F.lit(0.0))
    step = (m.alias("m").join(there.alias("t"), key("m", "t") & (F.col("m.parent") == F.col("t.up")), "left")
            .select("m.tree", "m.node", "t.up", own.alias("total")))
    steps = [written(step, "step0")]
    largest = m.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while 1 << (len(steps) - 1) < largest:  # after this round nobody looks back to a message
        s = steps[-1]
        # only messages that still look back to one; those at their root are done
        far = (s.where("up is not null").alias("s")
               .join(s.alias("t"), key("s", "t") & (F.col("s.up") == F.col("t.node")))
               .select("s.tree", "s.node", F.col("t.up").alias("up"),
                       (F.col("s.total") + F.col("t.total")).alias("total")))
        steps.append(written(s.where("up is null").unionByName(far), f"step{len(steps)}"))
        if steps[-1].where("up is not null").isEmpty():
            break
    parents = steps[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = (steps[-1].where("up is null").alias("s")
              .join(parents.alias("p"), key("s", "p") & (F.col("s.node") == F.col("p.node")), "left_anti"))
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), "node"))
    chosen = leaves.select("tree", F.col("node").alias("leaf"), F.col("total").alias("score"),
                           rank.alias("rank")).where(F.col("rank") <= top)
    path = chosen.select("tree", "leaf", "rank", "score", F.lit(0).cast("long").alias("hops"),
                         F.col("leaf").alias("node"))
    for i, s in enumerate(steps):
        back = (path.alias("p").join(s.where("up is not null").alias("s"),
                                     key("p", "s") & (F.col("p.node") == F.col("s.node")))
                .select("p.tree", "p.leaf", "p.rank", "p.score",
                        (F.col("p.hops") + F.lit(1 << i)).alias("hops"), F.col("s.up").alias("node")))
        path = written(path.unionByName(back), f"path{i}")
    return path


_FORMATTED = "formatted string, n_turns long, loss_spans array<struct<begin:long,end:long>>"


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, score, formatted, n_turns, loss_spans."""
    m = messages.groupBy("tree", "node").agg(F.min(F.struct(
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.col("parent").alias("parent"), F.col("score").alias("score"))).alias("m")).select("tree", "node", "m.*")
    m = written(m, "messages")
    path = _paths(m, top)
    turns = (path.alias("p").join(m.alias("m"), F.col("p.tree").eqNullSafe(F.col("m.tree"))
                                  & F.col("p.node").eqNullSafe(F.col("m.node")))
             .groupBy("p.tree", "p.leaf", "p.rank", "p.score")
             .agg(F.sort_array(F.collect_list(F.struct((-F.col("p.hops")).alias("at"), "m.role", "m.text")))
                  .alias("turns")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in ts]) for ts in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([d[0] for d in done], pa.string()),
                 pa.array([len(ts) for ts in batch.column(4).to_pylist()], pa.int64()),
                 pa.array([[{"begin": b, "end": e} for b, e in d[1]] for d in done], kind)],
                names=["tree", "leaf", "rank", "score", "formatted", "n_turns", "loss_spans"])

    schema = turns.drop("turns").schema
    for f in _fields(_FORMATTED):
        schema = schema.add(f)
    return turns.mapInArrow(write, schema)


def _fields(ddl: str):
    return StructType.fromDDL(ddl).fields


def of_conversations(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each turn answers the
    one before it, by (turn, role, text); equal turns are turns of their own."""
    node = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text").select(
        "tree", "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all taken from
    the formatted text and its loss spans."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[s["begin"]:s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                            hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                names=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = formatted.select("tree").schema
    for f in _fields("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                "formatted_chars long"):
        schema = schema.add(f)
    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(read, schema)


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'),
                                      '\[(\\*)(/?INST\])', '[\\\1\2', 'g')) AS n,
             length(url_encode(role)) AS r FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' THEN n + 7 ELSE n + r + 14 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
