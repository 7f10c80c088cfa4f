"""Hard-negative mining by a vertical scan with branch and bound (BOND).

Vectors are whole numbers, held column by column in blocks. For an anchor the
columns are read in the order of its falling magnitudes. After every few of
them, the smallest and largest contribution that the columns to come can still
make (from each column's minimum and maximum) bound the score of every
candidate, and the bitmap of candidates shrinks: first to those that can be
among the nearest of the anchor's label (positives), then to those that can be
among the best of another label inside a positive's window of scores. What
remains is scored to the last column, so the result is exact.

Every block of vectors meets every block of anchors in a task of its own, and
yields at most ``positives`` or ``negatives`` rows for an anchor or window.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import store

#: rows of a block of vectors and of a block of anchors, columns read between two looks at the bounds
BLOCK, ANCHORS, STEP = 8192, 2048, 8
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole_vectors(table: DataFrame, scale: int, id_col: str, label: F.Column, vector_col: str) -> DataFrame:
    """(id, label, v): rows that take part, components as floor(scale * x) in double precision."""
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = table.where(usable).select(F.col(id_col).alias("id"), label.alias("label"), x.alias("x"))
    # a floor kept as double is exact at any size
    return rows.where(F.col("label").isNotNull()).select(
        "id", "label", F.transform("x", lambda c: _floor(c * F.lit(float(scale)))).alias("v"))


def _floor(value):
    large = F.abs(value) >= F.lit(2.0 ** 52)
    return F.when(large, value).otherwise(F.floor(F.when(large, F.lit(0.0)).otherwise(value)).cast("double"))


class Block:
    """Vectors of one length, column by column, with each column's bounds."""

    def __init__(self, ids, labels, vectors, reach):
        """``reach``: largest magnitude of a component on the other side."""
        matrix = np.stack([np.asarray(v, "float64") for v in vectors]).reshape(len(ids), -1)
        width, own = matrix.shape[1], float(np.abs(matrix).max(initial=0))
        # whole numbers in a double are exact up to 2**53, in an int64 to 2**63, Python's at any size
        self.kind = "float64" if width * own * reach < 2 ** 52 else object
        self.columns = np.ascontiguousarray(self.convert(matrix).T)
        self.ids, self.labels = np.asarray(ids), np.asarray(labels)
        self.low = self.columns.min(axis=1) if width else self.columns.sum(axis=1)
        self.high = self.columns.max(axis=1) if width else self.columns.sum(axis=1)

    def convert(self, matrix):
        if self.kind is not object:
            return matrix
        return np.array([[int(x) for x in row] for row in matrix], object).reshape(matrix.shape)

    def scan(self, anchor, candidates, keep):
        """Places and scores of the candidates that ``keep(places, least, most)``
        lets through after every look at the bounds of their scores."""
        anchor = self.convert(np.asarray(anchor, "float64").reshape(1, -1))[0]
        order = np.argsort(-np.abs(anchor).astype("float64"), kind="stable")
        a = anchor[order]
        ends = a * self.low[order], a * self.high[order]
        # bounds of what the columns from the k-th on add
        least = np.concatenate([np.cumsum(np.minimum(*ends)[::-1])[::-1], [0]])
        most = np.concatenate([np.cumsum(np.maximum(*ends)[::-1])[::-1], [0]])
        score = np.zeros(len(candidates), self.columns.dtype)
        for at in range(0, len(order), STEP):
            read = order[at:at + STEP]
            score = score + a[at:at + STEP] @ self.columns[read][:, candidates]
            end = at + len(read)
            stay = keep(candidates, self.long(score + least[end]), self.long(score + most[end]))
            candidates, score = candidates[stay], score[stay]
            if not len(candidates):
                break
        return candidates, self.long(score)

    def long(self, values):
        """A score beyond a long is the nearest long."""
        return np.clip(values, _LEAST, _MOST) if self.kind is object else values


def _kth(values, k):
    """The k-th largest, or minus infinity where there are fewer."""
    if len(values) < k:
        return -np.inf
    if values.dtype == object:
        return sorted(values)[-k]
    return np.partition(values, len(values) - k)[len(values) - k]


def _first(ids, score, k):
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(score) > k:
        some = np.flatnonzero(score >= _kth(score, k))
    else:
        some = np.arange(len(score))
    return sorted(some.tolist(), key=lambda i: (-score[i], ids[i]))[:k]


def nearest(block: Block, anchor, anchor_id, label, k):
    """The anchor's ``k`` best other rows of its label in the block: (id, score)."""
    mates = np.flatnonzero((block.labels == label) & (block.ids != anchor_id))
    found, score = block.scan(anchor, mates, lambda at, least, most: most >= _kth(least, k))
    return [(block.ids[found[i]], int(score[i])) for i in _first(block.ids[found], score, k)]


def in_windows(block: Block, anchor, label, windows, k):
    """For every (low, high) of ``windows`` the ``k`` best rows of other labels in the block: (id, score)."""
    def keep(at, least, most):
        stay = np.zeros(len(at), bool)
        for low, high in windows:
            sure = (least >= low) & (most <= high)
            stay |= (least <= high) & (most >= max(low, _kth(least[sure], k)))
        return stay

    found, score = block.scan(anchor, np.flatnonzero(block.labels != label), keep)
    out = []
    for low, high in windows:
        inside = np.flatnonzero((score >= low) & (score <= high))
        out.append([(block.ids[found[inside[i]]], int(score[inside[i]]))
                    for i in _first(block.ids[found[inside]], score[inside], k)])
    return out


def window(positive: int):
    """The whole scores s with 50 * positive <= 100 * s <= 95 * positive; None if there are none."""
    low, high = -(-positive // 2), 95 * positive // 100
    return (low, high) if low <= high else None


def _unique(frame: pd.DataFrame) -> pd.DataFrame:
    """One row for each id (the first by label and vector), ordered by id."""
    keyed = frame.assign(_v=[tuple(v) for v in frame["v"]]).sort_values(["id", "label", "_v"])
    return keyed.drop_duplicates("id").drop(columns="_v").reset_index(drop=True)


def _pairs_of_blocks(rows: DataFrame, anchors: DataFrame, n: int, m: int, schema: str, search) -> DataFrame:
    """``search(block, anchor)`` yields rows for each block of vectors and each anchor.

    Both sides are dealt out by the hash of their id, so blocks are even whatever
    the labels are; only vectors of one length meet.
    """
    def dealt(df, own, count, other, others):
        return df.withColumn("dim", F.size("v")).withColumn(own, F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        left, right = _unique(left), _unique(right)
        reach = max(float(np.abs(np.asarray(v, "float64")).max(initial=0)) for v in right["v"])
        block = Block(left["id"].to_numpy(), left["label"].to_numpy(), left["v"], reach)
        return pd.DataFrame([r for anchor in right.itertuples() for r in search(block, anchor)], columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    keys = ["dim", "block", "batch"]
    return dealt(rows, "block", n, "batch", m).groupBy(keys).cogroup(
        dealt(anchors, "batch", m, "block", n).groupBy(keys)).applyInPandas(run, schema)


def _best(df: DataFrame, keys, id_col, k):
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), id_col)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 3) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has (id long, label int, v array<double> of whole numbers), as
    ``whole_vectors`` makes it; ``is_anchor`` says which rows are anchors. A
    score is the inner product; vectors of different lengths have none and never
    meet. Scores are exact; one beyond a long counts as the nearest long. Of rows that share an id the smallest by
    label and vector takes part. An anchor without positives, or a positive whose
    window holds no row, gives no rows; so does an empty table.
    """
    rows = store(rows, "vectors")
    anchors = store(rows.where(is_anchor), "anchors")
    counts = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    n, m = max(1, -(-counts[0] // BLOCK)), max(1, -(-counts[1] // ANCHORS))

    def mates(block, a):
        return [(a.id, i, s) for i, s in nearest(block, a.v, a.id, a.label, positives)]

    near = store(_best(_pairs_of_blocks(
        rows, anchors, n, m, "anchor_id long, positive_id long, score long", mates),
        ["anchor_id"], "positive_id", positives), "positives")
    wanted = near.groupBy(F.col("anchor_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("near"))

    def hard(block, a):
        spans = [(p, w) for p in a.near if (w := window(p["score"]))]
        # positives of one score share a window
        windows = sorted({w for _, w in spans})
        if not windows:
            return []
        found = dict(zip(windows, in_windows(block, a.v, a.label, windows, negatives)))
        return [(a.id, p["positive_id"], p["score"], i, s) for p, w in spans for i, s in found[w]]

    found = _pairs_of_blocks(
        rows, anchors.join(wanted, "id"), n, m,
        "anchor_id long, positive_id long, positive_score long, negative_id long, score long", hard)
    return _best(found, ["anchor_id", "positive_id"], "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(table: DataFrame, scale: int = 256, positives: int = 5, negatives: int = 3) -> DataFrame:
    """``mine`` for a table of (vec_id, embedding, label): components as
    floor(scale * x), anchors are the ids divisible by 50, and ids divisible by 7
    take the next label of ten. Rows with a null id, label or vector or a null,
    NaN or infinite component take no part; other columns are ignored."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_vectors(table, scale, "vec_id", moved.cast("int"), "embedding")
    return mine(rows.withColumn("id", F.col("id").cast("long")), F.col("id") % 50 == 0, positives, negatives)
