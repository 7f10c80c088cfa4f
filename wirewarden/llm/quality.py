"""Quality by naive Bayes support vectors: n-gram indicators scaled by class
log-count ratios, then a linear model with hinge loss by dual coordinate descent."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import in_small_batches
from .labelled import SAMPLE, TOKEN, fit_in_one_task, labelled_sample, score_column, scored, sigmoid

#: hash buckets of n-grams, least documents of one, smoothing of the counts
BUCKETS, LEAST_DOCS, ALPHA = 1 << 18, 3, 1.0
#: penalty of the hinge loss, most rounds, and the change of the dual that ends them
PENALTY, ROUNDS, TOLERANCE = 1.0, 60, 1e-3
#: length of the scaled indicators from which a text has its full weight
LENGTH = 8.0

#: codes of tokens: a hash of the lower-case form, and two flags above it
_WORD, _CAPITAL, _KNOWN, _MOST = 1 << 32, 1 << 33, {}, 100_000
_SAME, _CAPITALS = (zlib.crc32(x) % BUCKETS for x in (b"same same same", b"capitals capitals"))


def _code(token: str) -> int:
    if len(_KNOWN) >= _MOST:
        _KNOWN.clear()
    code = zlib.crc32(token.lower().encode("utf-8", "surrogatepass"))
    code |= _WORD * token[0].isalnum() | _CAPITAL * (len(token) > 1 and token.isupper())
    _KNOWN[token] = code
    return code


def ngrams(text: str) -> np.ndarray:
    """Buckets of the distinct tokens and pairs of neighbours of a whole text.

    Tokens are runs of letters, of digits, or of other characters, in lower
    case. Whatever the word, three of the same in a row count as an n-gram,
    and two neighbours in capitals as another."""
    get = _KNOWN.get
    codes = np.array([get(t) or _code(t) for t in TOKEN.findall(text)], "uint64")
    hashes = codes & np.uint64(_WORD - 1)
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    found = [(hashes % np.uint64(BUCKETS)).astype("int32"), (pairs >> np.uint64(40)).astype("int32") % BUCKETS]
    words = codes[codes & np.uint64(_WORD) > 0]
    if (same := words[1:] == words[:-1]).any() and (same[1:] & same[:-1]).any():
        found.append([_SAME])
    capital = words & np.uint64(_CAPITAL) > 0
    if (capital[1:] & capital[:-1]).any():
        found.append([_CAPITALS])
    return np.unique(np.concatenate(found)).astype("int32")


def log_count_ratio(labels, rows):
    """(ratio, documents) of every bucket: log of its smoothed share among good over bad documents."""
    flat = np.concatenate([*rows, np.empty(0, "int64")]).astype("int64")
    good = np.repeat(labels, [len(r) for r in rows]).astype(float)
    p = ALPHA + np.bincount(flat, weights=good, minlength=BUCKETS)
    q = ALPHA + np.bincount(flat, weights=1 - good, minlength=BUCKETS)
    return np.log(p / p.sum()) - np.log(q / q.sum()), np.bincount(flat, minlength=BUCKETS)


def dual_descent(rows, values, signs, size):
    """Weights minimising |w|²/2 + penalty * sum of hinge losses; the last weight is the bias.

    Coordinates go in a fixed random order each round; the box [0, penalty]
    holds every dual variable."""
    weight = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([(v * v).sum() + 1 for v in values])
    rng = np.random.default_rng(5)
    for _ in range(ROUNDS):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            gradient = signs[i] * (weight[rows[i]] @ values[i] + weight[size]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), PENALTY)
            change = (new - alpha[i]) * signs[i]
            if change:
                weight[rows[i]] += change * values[i]
                weight[size] += change
                worst = max(worst, abs(change))
                alpha[i] = new
        if worst < TOLERANCE * PENALTY:
            break
    return weight


def calibrate(margins, labels):
    """Slope and offset of a logistic curve through the margins, by Newton steps on smoothed targets."""
    n1 = labels.sum()
    n0 = len(labels) - n1
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(slope * margins + offset)
        error, w = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(error * margins).sum() + 1e-3 * (slope - 1), error.sum()])
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(slope, 1e-3), offset


def _values(ratio, row):
    """Scaled indicators of a row, brought to length 1 at most, so that long texts
    weigh no more, while short ones say less."""
    v = ratio[row]
    return v / max(np.sqrt((v * v).sum()), LENGTH)


def fit(labels, rows) -> pd.DataFrame:
    """Rows of (bucket, ratio, weight); -1 holds bias and 0, -2 slope and offset of the calibration."""
    ratio, df = log_count_ratio(labels, rows)
    ratio[df < LEAST_DOCS] = 0
    rows = [r[ratio[r] != 0] for r in rows]
    values = [_values(ratio, r) for r in rows]
    weight = dual_descent(rows, values, np.where(labels == 1, 1.0, -1.0), BUCKETS)
    margins = np.array([weight[r] @ v + weight[BUCKETS] for r, v in zip(rows, values)])
    slope, offset = calibrate(margins, labels)
    used = np.nonzero(ratio)[0]
    return pd.DataFrame({
        "bucket": np.append(used, [-1, -2]), "ratio": np.append(ratio[used], [weight[BUCKETS], slope]),
        "weight": np.append(weight[used], [0.0, offset])})


class Model:
    def __init__(self, frame: pd.DataFrame):
        self.ratio, self.weight = np.zeros(BUCKETS), np.zeros(BUCKETS)
        self.bias, self.slope, self.offset = 0.0, 1.0, 0.0
        if len(frame):
            special = frame[frame["bucket"] < 0].set_index("bucket")
            self.bias = float(special["ratio"][-1])
            self.slope, self.offset = float(special["ratio"][-2]), float(special["weight"][-2])
            frame = frame[frame["bucket"] >= 0]
            self.ratio[frame["bucket"]] = frame["ratio"]
            self.weight[frame["bucket"]] = frame["weight"]

    def score(self, text: str) -> float:
        row = ngrams(text)
        return float(sigmoid(self.slope * (self.weight[row] @ _values(self.ratio, row) + self.bias) + self.offset))


def train(docs: DataFrame, labels: DataFrame, where, label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on a bounded sample of the labels that ``where`` admits; without any, all texts score 0.5."""
    return Model(fit_in_one_task(
        labelled_sample(docs, labels, label_col, where, sample), ngrams, fit,
        "bucket long, ratio double, weight double"))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of every row from its whole text.

    A null text is an empty one and scores by the bias. Repeated rows are
    scored each; extra columns are ignored; no rows: no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda text: sent.value.score(text), threshold)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = in_small_batches(docs).select(F.struct(*docs.columns).alias("row"), F.col("text"))
    marked = rows.withColumn("score", score_column(lambda text: sent.value.score(text)))
    return marked.where(F.col("score") >= threshold).select("row.*")
