"""Quality rules with cross-document line frequency (DataFrame and SQL functions only).

Lines are normalised (white space at both ends off, A-Z lower-cased) and hashed; the
distinct documents holding a line are counted per host (`source`).  A line held by more
than ``max(min_docs, share * documents of the host)`` documents is above the limit and is
removed from every document of that host except the one with the smallest doc_id, so that
the content itself is never lost.  A document is depleted, and rejected, when fewer than
``min_left_pct`` percent of its words remain.

Defined cases: a document is a distinct (doc_id, source, text), so repeated rows count once
and all get the same verdict; null source is a host of its own; a null text has no words;
a blank line is never counted; columns other than these three are not read by `judge`.

No group is gathered: counts are partial aggregates, the frequent lines join back on
(host, hash), and repeated word windows are found inside the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcycle.llm.common import WORD, ascii_lower, columns, unused, written
from tillcycle.llm.source_mix import source_key

MIN_DOCS, SHARE, MIN_LEFT_PCT = 10, 0.005, 30


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), text.alias("text"), source_key(F.col("source")).alias("host"),
                       F.xxhash64(F.lit(1), "source", "text").alias("body"))


def _lines(keyed: DataFrame) -> DataFrame:
    """(doc_id, body, host, pos, line hash, words) per line that holds a word."""
    raw = keyed.select("doc_id", "body", "host", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    trimmed = ascii_lower(F.btrim("line", F.lit(" \t\n\x0b\f\r")))
    return (raw.select("doc_id", "body", "host", "pos", trimmed.alias("line")).where("line <> ''")
            .select("doc_id", "body", "host", "pos", F.xxhash64("line").alias("h"),
                    F.regexp_count("line", F.lit(WORD)).cast("long").alias("words")))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(host, h, n_docs, keeper): the lines above their host's limit."""
    keyed = _keyed(docs)
    held = (_lines(keyed).groupBy("host", "h")
            .agg(F.count_distinct(F.struct("doc_id", "body")).alias("n_docs"), F.min("doc_id").alias("keeper"))
            .where(F.col("n_docs") > min_docs))
    hosts = (keyed.groupBy("host").agg(F.count_distinct(F.struct("doc_id", "body")).alias("host_docs")))
    return (held.join(hosts, "host").where(F.col("n_docs") > F.lit(share) * F.col("host_docs"))
            .select("host", "h", "n_docs", "keeper"))


def removed_lines(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, body, pos, words): a row for each line of a document that goes."""
    lines, freq = _lines(_keyed(docs)).alias("l"), frequent_lines(docs, **limits).alias("f")
    return (lines.join(freq, (F.col("l.host") == F.col("f.host")) & (F.col("l.h") == F.col("f.h"))
                       & ~F.col("l.doc_id").eqNullSafe(F.col("f.keeper")))
            .select("l.doc_id", "l.body", "l.pos", "l.words").dropDuplicates(["doc_id", "body", "pos"]))


def base_rules(docs: DataFrame) -> DataFrame:
    """The per-document counts.  Three-word windows are sorted as (hash, position) packed in
    one long, so equal windows are neighbours; neighbours are compared word by word."""
    d = _keyed(docs).select("doc_id", "body", "text", F.regexp_extract_all("text", F.lit(WORD), 0).alias("w"),
                            F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("ln"))
    d = d.select(
        "doc_id", "body", "w", F.size("w").alias("n"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long").alias("n_dup_lines"))
    d = d.withColumn("b", F.ceil(F.log2(F.col("n") + 2)).cast("int"))
    d = d.withColumn("p", F.expr(
        "if(n < 3, cast(array() as array<bigint>), sort_array(transform(sequence(0, n - 3), i -> "
        "shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), b) | cast(i as bigint))))"))
    at = "cast({} & (shiftleft(1L, b) - 1) as int)"
    one, two = at.format("x"), at.format("y")
    same = (f"(shiftright(x, b) = shiftright(y, b) and w[{one}] = w[{two}] and w[{one} + 1] = w[{two} + 1] "
            f"and w[{one} + 2] = w[{two} + 2])")
    before, after = same.replace("y", "p[j - 1]"), same.replace("y", "p[j + 1]")
    d = d.withColumn("q", F.expr(
        f"sort_array(transform(filter(p, (x, j) -> (j > 0 and {before}) or (j + 1 < size(p) and {after})), "
        f"x -> {one}))"))
    d = d.withColumn("n_repeat_words", F.expr(
        "aggregate(transform(q, (x, i) -> if(i + 1 < size(q), least(3, q[i + 1] - x), 3)), 0L, (a, v) -> a + v)"))
    return d.select("doc_id", "body", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols",
                    "n_dup_lines", "n_repeat_words",
                    ((F.col("n") < 50) | (F.col("n_repeat_words") * 100 > F.col("n") * 50)).alias("base_failed"))


def judge(docs: DataFrame, min_left_pct: int = MIN_LEFT_PCT, removed: DataFrame | None = None,
          **limits) -> DataFrame:
    """One row per input row: the base counts, words_left and the verdict `kept`."""
    gone = (removed_lines(docs, **limits) if removed is None else removed).groupBy("doc_id", "body").agg(F.sum("words").alias("gone")).alias("g")
    # written: a filter on the verdict must not be pushed into, and repeat, the array work
    base = written(base_rules(docs), "base").alias("d")
    out = base.join(gone, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.body") == F.col("g.body")),
                    "left")
    out = out.select("d.*", (F.col("d.n_words") - F.coalesce(F.col("g.gone"), F.lit(0))).alias("words_left"))
    left_enough = F.col("words_left") * 100 >= F.col("n_words") * min_left_pct
    return out.withColumn("kept", ~F.col("base_failed") & left_enough)


def clean(docs: DataFrame, min_left_pct: int = MIN_LEFT_PCT, **limits) -> DataFrame:
    """The kept documents, all columns, without the lines above the limits; `n_chars`, if
    there, follows the text."""
    gone_at, own, own_id, own_body = unused(docs, "gone_at", "own", "own_id", "own_body")
    removed = written(removed_lines(docs, **limits), "removed")
    kept = judge(docs, min_left_pct, removed).where("kept").select("doc_id", "body").distinct()
    gone = removed.groupBy("doc_id", "body").agg(F.collect_set("pos").alias(gone_at))
    verdict = kept.join(gone, kept["doc_id"].eqNullSafe(gone["doc_id"]) & (kept["body"] == gone["body"]), "left") \
        .select(kept["doc_id"].alias(own_id), kept["body"].alias(own_body), gone_at)
    rows = docs.withColumn(own, F.xxhash64(F.lit(1), "source", "text"))
    out = rows.join(verdict, rows["doc_id"].eqNullSafe(F.col(own_id)) & (F.col(own) == F.col(own_body)))
    fewer = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone_at, i)), "\n")
    out = out.withColumn("text", F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(fewer))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone_at).isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*columns(docs))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS host FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^ 	-
]+') AS w FROM d),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM
          (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM win WHERE c > 1) GROUP BY doc_id),
raw AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, host, line, lower_ascii AS norm, len(regexp_extract_all(line, '[^ 	-
]+')) AS words
       FROM (SELECT *, translate(regexp_replace(regexp_replace(line, '^[ 	-
]+', ''), '[ 	-
]+$', ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM raw)
       WHERE lower_ascii <> ''),
hosts AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
freq AS (SELECT host, norm, min(doc_id) AS keeper FROM ln JOIN hosts USING (host) GROUP BY host, norm
         HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > 0.005 * min(host_docs)),
gone AS (SELECT doc_id, sum(words) AS gone FROM ln JOIN freq USING (host, norm) WHERE doc_id <> keeper GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, len(array_to_string(w.w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             coalesce(gone, 0) AS gone
      FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND (n_words - gone) * 100 >= n_words * 30) AS kept FROM b
"""
