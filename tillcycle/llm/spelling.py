"""Spelling variants: words one edit apart, found by asymmetric chunks, grouped under their forms.

1. Words are counted per batch inside tasks, then summed.
2. Of two words one edit apart, the shorter one (of equal lengths, either) contributes its two
   disjoint halves, the longer one the positional grams that can meet them: one edit leaves one
   half whole.  What is before the edit keeps its place, what is behind it moves by the
   difference of the lengths, one at most; so of all grams within shift one of a half only
   that at its own place (first half) or at its place plus the difference (second half) is
   needed.  Words meet on (length, half, gram), and each meeting is verified by edit distance.
3. Where a gram brings over ``max_meetings`` pairs together, its words are dealt anew by the halves of
   what is left of them beside the gram, which is itself one edit apart: common syllables do
   not bring all pairs of their words together.
4. A word's form is its near word of largest count if that is ``ratio`` times its own; roots
   are found by following forms in doubling steps.

Defined cases: null texts have no words; a null id reads as an empty one; rows that repeat each
other all count; other columns are not read; no words, no rows.  Grams meet by hash, which can
only add meetings that fail the verification.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcycle.llm.common import UPPER, written

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, RATIO, SLIP, MAX_MEETINGS = 6, 5, 5, 199, 1 << 16
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_TALLY = 1 << 18


def slipped(word: str, doc: str, slip: int) -> str:
    """The word, without one code point if ``slip`` divides the checksum of its place."""
    h = zlib.crc32(f"{doc}:{word}".encode())
    if h % slip:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _tally(letters: str, shortest: int, slip: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, tally = re.compile(f"[{letters}]+"), Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.string()),
                                               pa.array(tally.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for word, n in Counter(runs.findall(text.encode().translate(_LOWER).decode())).items():
                    if len(word) < shortest:
                        continue
                    word = slipped(word, doc, slip) if slip else word
                    if len(word) >= shortest:
                        tally[word] += n
                if len(tally) > _TALLY:
                    yield counted()
                    tally = Counter()
        yield counted()
    return run


def words(docs: DataFrame, letters: str = LETTERS, shortest: int = SHORTEST, least: int = LEAST,
          slip: int | None = SLIP) -> DataFrame:
    """(word, n): the words of all texts that occur ``least`` times or more."""
    d = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    return (d.mapInArrow(_tally(letters, shortest, slip), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))


def _halves(rows: DataFrame) -> DataFrame:
    """(word, n, shift, path, rest) to two rows each: the path goes on with a half of the rest's
    ``length(rest) - shift`` code points, the rest is what the half leaves."""
    rest, shift = F.col("rest"), F.col("shift")
    size = F.char_length(rest) - shift
    q = F.floor(size / 2).cast("int")

    def way(half: int, gram: Column, left: Column) -> Column:
        return F.struct(F.xxhash64("path", size, F.lit(half), gram).alias("path"), left.alias("rest"))

    first = way(0, F.substring(rest, F.lit(1), q), F.substring(rest, q + 1, F.char_length(rest)))
    second = way(1, F.substring(rest, q + shift + 1, F.char_length(rest)), F.substring(rest, F.lit(1), q + shift))
    return rows.withColumn("way", F.explode(F.array(first, second))).select("word", "n", "shift", "way.path", "way.rest")


def near_pairs(vocabulary: DataFrame, max_meetings: int = MAX_MEETINGS) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words one inserted, deleted or replaced code point apart,
    once; a is the shorter, or the first, of the two."""
    start = vocabulary.select("word", "n", F.lit(0).cast("long").alias("path"), F.col("word").alias("rest"))
    chunks = start.withColumn("shift", F.lit(0))
    grams = start.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1))))
    found = None
    while True:
        chunks, grams = written(_halves(chunks), "chunks"), written(_halves(grams), "grams")
        count = lambda rows, name: rows.groupBy("path").agg(F.count(F.lit(1)).alias(name))
        crowded = written(count(chunks, "x").join(count(grams, "y"), "path")
                          .where(F.col("x") * F.col("y") > max_meetings).select("path"), "crowded")
        more = not crowded.isEmpty()
        # halves of one code point can't be halved: what is left of such words has two at most
        last = F.char_length("rest") - F.col("shift") < 2
        a = chunks.join(crowded.withColumn("deep", F.lit(True)), "path", "left") if more else chunks.withColumn("deep", F.lit(None))
        b = grams.join(crowded.withColumn("deep", F.lit(True)), "path", "left") if more else grams.withColumn("deep", F.lit(None))
        here = F.col("deep").isNull() | last
        c, g = a.where(here).alias("c"), b.where(here).alias("g")
        meet = c.join(g, F.col("c.path") == F.col("g.path")).where(
            (F.char_length("c.word") < F.char_length("g.word")) | (F.col("c.word") < F.col("g.word"))).where(
            F.levenshtein(F.col("c.word"), F.col("g.word"), 1) == 1)
        pairs = written(meet.select(F.col("c.word").alias("a"), F.col("c.n").alias("n_a"),
                                    F.col("g.word").alias("b"), F.col("g.n").alias("n_b")), "pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if not more:
            return found.dropDuplicates(["a", "b"])
        chunks, grams = (x.where(~here).drop("deep") for x in (a, b))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, twice as far in each round."""
    to = written(links.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        on = to.select(F.col("word").alias("at"), F.col("root").alias("next"))
        after = written(to.join(on, F.col("root") == F.col("at")).select(
            "word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        to = after.select("word", "root")
        if after.where("moved").isEmpty():
            return to


def variants(docs: DataFrame, ratio: int = RATIO, max_meetings: int = MAX_MEETINGS, **kw) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    vocabulary = written(words(docs, **kw), "words")
    pairs = written(near_pairs(vocabulary, max_meetings), "near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"),
                                          F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best"))
    follows = -F.col("best.less") >= ratio * F.col("n")
    linked = written(vocabulary.join(best, "word", "left").select(
        "word", F.when(follows, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(follows, -F.col("best.less")).alias("form_n")), "linked")
    return linked.join(_roots(linked), "word").select("word", "form", "root", "n", "n_near", "form_n")
