"""Toxicity by a factorization machine over hashed terms.

Every selected term has a weight and a vector; the product of two vectors is
the weight of the pair, so an insult next to the mention of a group can count
for more than the two alone, which a linear model can't express.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .labelled import SAMPLE, WORD, Hasher, fit_in_one_task, labelled_sample, scored, sigmoid, stretches

#: hash buckets of terms, most terms in the model, least chi-square and documents of a term, length of vectors
BUCKETS, TERMS, LEAST_CHI, LEAST_DOCS, RANK = 1 << 20, 4096, 15.0, 4, 8
#: the most frequent terms whose pairs are tried, and the least chi-square of a pair (two million are tried)
PAIRED, LEAST_PAIR = 2000, 40.0
EPOCHS, BATCH, RATE = 30, 128, 0.02


def affixes(word: str):
    """A word with its beginnings and its end, so that inflected forms share terms."""
    return word, "^" + word[:4], "^" + word[:5], word[-4:] + "$"


_HASH = Hasher(BUCKETS, affixes)


def terms(text: str) -> np.ndarray:
    """Buckets of the distinct words of a whole text and their affixes, in lower case."""
    return _HASH(set(WORD.findall(text.lower())))


def select_terms(labels, rows):
    """Buckets whose documents differ most from the rest in their labels, by
    chi-square, and those that do so only next to another one."""
    flat = np.concatenate([*rows, np.empty(0, "int64")]).astype("int64")
    marks = np.repeat(labels, [len(r) for r in rows])
    df = np.bincount(flat, minlength=BUCKETS).astype(float)
    hit = np.bincount(flat, weights=marks, minlength=BUCKETS)
    n, p = len(labels), labels.sum()
    miss = df - hit
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (hit * (n - p - miss) - miss * (p - hit)) ** 2 / (df * (n - df) * p * (n - p))
    chi = np.where((df >= LEAST_DOCS) & np.isfinite(chi), chi, 0)
    order = np.lexsort((np.arange(BUCKETS), -chi))[:TERMS]
    single = order[chi[order] >= LEAST_CHI]
    return np.unique(np.concatenate([single, paired_terms(labels, rows, df)]))


def paired_terms(labels, rows, df):
    """Terms of pairs whose documents' labels differ from what the two terms alone
    explain: the labels' deviation, summed over documents that hold both or neither
    less those that hold one, in units of its spread."""
    n = len(labels)
    frequent = np.lexsort((np.arange(BUCKETS), -np.minimum(df, n - df)))[:PAIRED]
    frequent = np.sort(frequent[np.minimum(df, n - df)[frequent] >= LEAST_DOCS])
    if not len(frequent):
        return frequent
    place = np.full(BUCKETS, -1)
    place[frequent] = np.arange(len(frequent))
    together = np.zeros((len(frequent), len(frequent)), "float32")
    share = (df[frequent] / n).astype("float32")
    deviation = (labels - labels.mean()).astype("float32")
    for at in range(0, n, 1000):
        part = np.repeat(-share[None], len(rows[at:at + 1000]), axis=0)
        for i, row in enumerate(rows[at:at + 1000]):
            held = place[row]
            part[i, held[held >= 0]] += 1
        together += (part * deviation[at:at + 1000, None]).T @ part
    spread = share * (1 - share)
    chi = together ** 2 / np.maximum(n * deviation.var() * np.outer(spread, spread), 1e-9)
    # a term next to itself says nothing
    np.fill_diagonal(chi, 0)
    a, b = np.nonzero(chi >= LEAST_PAIR)
    best = np.argsort(-chi[a, b], kind="stable")[:TERMS]
    return np.unique(frequent[np.concatenate([a[best], b[best]])])


def machine(bias, weight, vector, flat, starts):
    """Raw score of rows given as one array of term numbers and row starts."""
    total = np.add.reduceat(vector[flat], starts, axis=0)
    square = np.add.reduceat((vector * vector).sum(1)[flat], starts)
    return bias + np.add.reduceat(weight[flat], starts) + ((total * total).sum(1) - square) / 2


def fit(labels, rows) -> pd.DataFrame:
    """Logistic loss, Adam, mini-batches in a fixed order. Row -1 is the bias; a
    pad term with zero weights stands in every row, so that none is empty."""
    chosen = select_terms(labels, rows)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    pad = len(chosen)
    rows = [np.append(x[x >= 0], pad) for x in (place[r] for r in rows)]
    rng = np.random.default_rng(11)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias, weight = np.array([np.log(share / (1 - share))]), np.zeros(pad + 1)
    vector = rng.normal(0, 0.05, (pad + 1, RANK))
    vector[pad] = 0
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (bias, weight, vector)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at:at + BATCH]
            flat, starts = stretches([rows[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), [len(rows[i]) for i in batch])
            total = np.add.reduceat(vector[flat], starts, axis=0)
            error = (sigmoid(machine(bias[0], weight, vector, flat, starts)) - labels[batch]) / len(batch)
            grads = [np.array([error.sum()]), np.zeros_like(weight), np.zeros_like(vector)]
            np.add.at(grads[1], flat, error[row])
            np.add.at(grads[2], flat, error[row, None] * (total[row] - vector[flat]))
            grads[1][pad] = 0
            grads[2][pad] = 0
            step += 1
            for x, g, (m, v) in zip((bias, weight, vector), grads, state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return pd.DataFrame({
        "bucket": np.append(chosen, -1), "weight": np.append(weight[:-1], bias),
        "vector": [*vector[:-1], np.zeros(RANK)]})


class Model:
    """Weights and vectors by bucket; an empty model scores every text ``share``."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values("bucket", ignore_index=True)
        self.bias = float(frame["weight"][0]) if len(frame) else 0.0
        self.bucket = frame["bucket"].to_numpy("int64")[1:]
        self.weight = frame["weight"].to_numpy("float64")[1:]
        self.vector = np.stack([*frame["vector"], np.zeros(RANK)]).astype("float64")[1:-1] if len(frame) else None

    def score(self, text: str) -> float:
        found = terms(text)
        if not len(found) or not len(self.bucket):
            return float(sigmoid(self.bias))
        at = np.searchsorted(self.bucket, found)
        at = at[self.bucket[np.minimum(at, len(self.bucket) - 1)] == found]
        v = self.vector[at]
        pairs = ((v.sum(0) ** 2) - (v * v).sum(0)).sum() / 2
        return float(sigmoid(self.bias + self.weight[at].sum() + pairs))


def train(docs: DataFrame, labels: DataFrame, where, label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on a bounded sample of the labels that ``where`` admits; without any, all texts score 0.5."""
    return Model(fit_in_one_task(
        labelled_sample(docs, labels, label_col, where, sample), terms, fit,
        "bucket long, weight double, vector array<double>"))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row from its whole text.

    A null text is an empty one and scores the bias. Repeated rows are scored
    each; extra columns are ignored; no rows: no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda text: sent.value.score(text), threshold)
