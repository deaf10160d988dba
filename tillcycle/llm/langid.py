"""Language of whole texts by a linear-chain conditional random field over their words.

The model is fitted on a bounded sample of the labelled documents outside the held-out fold: of
each language, of which none is left out, the ``PER_LANG`` documents with the least hash are cut into
sequences of ``CHUNK`` words, and the ``PER_LANG_CHUNKS`` sequences with the least hash of (doc_id, place)
are kept; where the languages are so many that this is above ``ALL_CHUNKS`` sequences in all, each gives its
equal part, and one at least.  Words of more than ``LONGEST`` letters are not learned from.  So the driver
gets ``ALL_CHUNKS * CHUNK * LONGEST`` letters at most, whatever the texts.  Every third sequence is
spliced to one of another document, so that transitions between languages are learned as in
code-switched text.  Only text and lang of these documents are used.

Every text is labelled word by word, whole; the language with the most marginal mass is the
prediction and its share the score.  `runs` lists the languages in the order of the text.

Defined cases: null text or one without letters: `und`, score 0; no labelled document at all:
every text is `und`; very long texts are
labelled whole, in slices of their own; repeated rows count as rows; ties go to the language first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillcycle.llm.crf import Crf, Labeller, words_of

PER_LANG, PER_LANG_CHUNKS, ALL_CHUNKS, CHUNK, LONGEST, FOLDS, HELD = 150, 1000, 8000, 100, 64, 4, 2


def held_out():
    """The documents whose crc32(doc_id as text) mod 4 is 2; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, doc_id, at, words) of each text's sequences."""
    for batch in batches:
        out: list[tuple] = []
        for lang, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = [w for w in words_of(text) if len(w) <= LONGEST]
            out += [(lang, doc_id, i, words[i:i + CHUNK]) for i in range(0, len(words), CHUNK)]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            cols, (pa.string(), batch.column(1).type, pa.int64(), pa.list_(pa.string())), strict=True)],
            names=["lang", "doc_id", "at", "words"])


def sample(docs: DataFrame, per_lang: int = PER_LANG, per_lang_chunks: int = PER_LANG_CHUNKS,
           all_chunks: int = ALL_CHUNKS) -> list[tuple[list[str], str]]:
    """(words, lang) of the sequences to learn from, in a fixed order."""
    d = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "doc_id", "text")
    langs = d.select("lang").distinct().count()
    each = max(1, min(per_lang_chunks, all_chunks // max(1, langs)))
    rank = lambda *by: F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64(*by), *by))
    docs_each = min(per_lang, each)
    ids = d.select("lang", "doc_id").distinct().withColumn("rank", rank("doc_id")) \
        .where(F.col("rank") <= docs_each).select("lang", "doc_id")
    if langs * docs_each <= 1_000_000:  # rows of ids at most
        ids = F.broadcast(ids)
    texts = d.join(ids, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    kind = f"lang string, doc_id {dict(d.dtypes)['doc_id']}, at long, words array<string>"
    cut = texts.select("lang", "doc_id", "text").mapInArrow(_chunks, kind)
    rows = cut.withColumn("rank", rank("doc_id", "at")).where(F.col("rank") <= each) \
        .select("words", "lang").collect()  # bounded: all_chunks sequences, or one a language
    return sorted((list(r["words"]), r["lang"]) for r in rows)


def sequences(chunks: list[tuple[list[str], str]]) -> list[tuple[list[str], list[str]]]:
    out = [(words, [lang] * len(words)) for words, lang in chunks]
    rng = np.random.default_rng(0)
    other = rng.permutation(len(out))
    return [(w[:len(w) // 2] + out[o][0][:len(out[o][0]) // 2], y[:len(w) // 2] + out[o][1][:len(out[o][0]) // 2])
            if i % 3 == 0 and len(w) > 1 else (w, y) for i, ((w, y), o) in enumerate(zip(out, other, strict=True))]


def fit(docs: DataFrame, per_lang: int = PER_LANG, **kw) -> Crf | None:
    seqs = [s for s in sequences(sample(docs, per_lang)) if s[0]]
    return Crf.fit(seqs, **kw) if seqs else None


def _in_slices(labeller: Labeller, texts: list[str], chars: int = 1_000_000):
    """`Labeller.marginals` of so many texts at a time that their words stay small in memory."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= chars):
            size += len(texts[to])
            to += 1
        for i, gamma in labeller.marginals(texts[at:to]):
            yield at + i, gamma
        at = to


_labellers: dict[str, tuple[Crf, Labeller]] = {}
_SCHEMA = "doc_id long, lang_pred string, score double, runs array<struct<lang:string,words:long>>"


def predict(docs: DataFrame, model: Crf | None, with_runs: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and the runs of equal labels, per row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
        model = sent.value
        if model is not None and _labellers.get("now", (None,))[0] is not model:
            _labellers["now"] = (model, Labeller(model))  # one per worker and model
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            runs: list[list[dict]] = [[] for _ in texts]
            found = _in_slices(_labellers["now"][1], texts) if model is not None else ()
            for i, gamma in found:
                mass = gamma.mean(axis=0, dtype=np.float64)
                best = int(mass.argmax())
                langs[i], scores[i] = model.labels[best], float(min(1.0, mass[best]))
                if with_runs:
                    y = gamma.argmax(axis=1)
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(y)) + 1, [len(y)]])
                    runs[i] = [{"lang": model.labels[y[a]], "words": int(b - a)} for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs), pa.array(scores), pa.array(runs, kind)],
                names=["doc_id", "lang_pred", "score", "runs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(label, _SCHEMA)


def identify(docs: DataFrame, **kw) -> DataFrame:
    """Fits on the sample and predicts every row: doc_id, held_out, lang_pred, score, runs."""
    return predict(docs, fit(docs, **kw)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "runs")
