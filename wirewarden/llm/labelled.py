"""What the two text classifiers share: a bounded labelled sample and hashed features."""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import frugal, give_back, in_small_batches

#: labelled documents that a classifier is fitted on
SAMPLE = 8000


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, where, sample: int = SAMPLE) -> DataFrame:
    """(label, text) of the ``sample`` labelled documents with the smallest hashes of doc_id.

    ``where`` says which rows may be learned from. Null labels and null ids
    don't count; of several labels of one document the largest does. A
    document id that repeats in ``docs`` gives a row each.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).where(where)
        .groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    return in_small_batches(docs.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id").select(
        "label", F.coalesce("text", F.lit("")).alias("text"))


class Hasher:
    """Distinct buckets of strings, remembered up to a bound; ``parts`` of a string are hashed with it."""

    def __init__(self, buckets, parts=lambda term: (term,), most=100_000):
        self.buckets, self.parts, self.most, self.known = buckets, parts, most, {}

    def _add(self, term):
        if len(self.known) >= self.most:
            self.known.clear()
        found = self.known[term] = tuple(
            zlib.crc32(part.encode("utf-8", "surrogatepass")) % self.buckets for part in self.parts(term))
        return found

    def __call__(self, terms):
        get, out = self.known.get, []
        for term in terms:
            out.extend(get(term) or self._add(term))
        return np.unique(np.array(out, "int32"))


WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")


def fit_in_one_task(sample: DataFrame, features, fit, schema: str) -> pd.DataFrame:
    """Features of the sample made by all tasks, the model fitted by one.

    ``features(text)`` gives sorted distinct ints; ``fit(labels, rows)`` a frame
    of ``schema``, whose size is bounded by the number of buckets. The sample
    is bounded, so the one task and the driver are too.
    """

    def extract(frames):
        for frame in frames:
            yield pd.DataFrame({"label": frame["label"], "row": [features(t) for t in frame["text"]]})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        # the order of rows must not depend on how they arrived
        rows = [np.asarray(r, "int64") for r in frame["row"]]
        keys = [(int(label), r.tobytes()) for label, r in zip(frame["label"], rows)]
        order = sorted(range(len(rows)), key=keys.__getitem__)
        order = np.random.default_rng(7).permutation(np.array(order, "int64"))
        fitted = fit(frame["label"].to_numpy("int64")[order], [rows[i] for i in order])
        del rows, keys
        give_back()
        return fitted

    extracted = sample.mapInPandas(frugal(extract), "label int, row array<int>")
    return extracted.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda f: run(f), schema).toPandas()


def stretches(rows):
    """All features in one array and the start of each row; an empty row would break reduceat, so none may be."""
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]).astype("int64")
    return np.concatenate(rows), starts


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def score_column(score_text, text: str = "text") -> Column:
    """Scores of a text column by a function of the whole text; a null text is an empty one."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from frugal(lambda all_texts: (
            pd.Series([score_text(t or "") for t in texts], dtype="float64") for texts in all_texts))(batches)

    return score(text)


def scored(docs: DataFrame, score_text, threshold: float) -> DataFrame:
    """(doc_id, score, predicted) of every row by a function of the text."""
    return in_small_batches(docs).select("doc_id", score_column(score_text).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
