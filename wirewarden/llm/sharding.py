"""Best-fit-decreasing sharding: groups that must stay together, packed into shards of a fixed capacity.

Groups are sorted by size; each enters the shard with the smallest remaining
capacity that still holds it, found in a balanced search tree. Equal texts are
one group. Groups are packed in two levels, so that no task or driver sees
them all: tasks of bounded size pack their groups into parcels (a fixed
fraction of a shard), and the parcels, whose number does not depend on the
number of documents, are packed into the shards.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import numbered, slices_for, store

#: parcels a shard is made of, and groups that one packing task holds
PARCELS_PER_SHARD, GROUPS_PER_TASK = 256, 50_000


class CapacityTree:
    """Balanced search tree (AA tree) over (remaining capacity, bin)."""

    def __init__(self):
        self.root = None  # a node is [key, level, left, right]

    def ceiling(self, capacity):
        """The smallest key whose capacity is at least ``capacity``, or None."""
        node, best = self.root, None
        while node:
            if node[0][0] >= capacity:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def largest(self):
        node = self.root
        while node and node[3]:
            node = node[3]
        return node and node[0]

    def add(self, key):
        self.root = self._add(self.root, key)

    def remove(self, key):
        self.root = self._remove(self.root, key)

    @staticmethod
    def _skew(node):
        left = node[2]
        if left and left[1] == node[1]:
            node[2], left[3] = left[3], node
            return left
        return node

    @staticmethod
    def _split(node):
        right = node[3]
        if right and right[3] and right[3][1] == node[1]:
            node[3], right[2] = right[2], node
            right[1] += 1
            return right
        return node

    def _add(self, node, key):
        if not node:
            return [key, 1, None, None]
        side = 2 if key < node[0] else 3
        node[side] = self._add(node[side], key)
        return self._split(self._skew(node))

    def _remove(self, node, key):
        if not node:
            return None
        if key != node[0]:
            side = 2 if key < node[0] else 3
            node[side] = self._remove(node[side], key)
        elif not node[2] and not node[3]:
            return None
        else:
            side = 2 if node[2] else 3
            near = node[side]
            while near[5 - side]:
                near = near[5 - side]
            node[0] = near[0]
            node[side] = self._remove(node[side], near[0])
        level = min((child[1] if child else 0) for child in (node[2], node[3])) + 1
        if level < node[1]:
            node[1] = level
            if node[3] and node[3][1] > level:
                node[3][1] = level
        node = self._skew(node)
        if node[3]:
            node[3] = self._skew(node[3])
            if node[3][3]:
                node[3][3] = self._skew(node[3][3])
        node = self._split(node)
        if node[3]:
            node[3] = self._split(node[3])
        return node


def best_fit_decreasing(sizes, capacity, bins=None):
    """Bin of every size, in the order given; sizes must come largest first.

    Without ``bins`` a new bin is opened whenever none holds the item, and an
    item beyond the capacity gets a bin of its own. With ``bins`` that many are
    open from the start, and what fits nowhere goes to the roomiest.
    """
    tree, out, opened = CapacityTree(), [], 0
    for b in range(bins or 0):
        tree.add((capacity, b))
    for size in sizes:
        key = tree.ceiling(size)
        if key is None and bins:
            key = tree.largest()
        if key is None:
            key = (max(capacity, size), opened)
            opened += 1
        else:
            tree.remove(key)
        tree.add((key[0] - size, key[1]))
        out.append(key[1])
    return out


def level_bins(sizes, bins):
    """Bins of near-equal load for sizes given largest first: a size beyond the
    mean of what is left takes a bin of its own, the rest are packed by best
    fit into the others with their mean as capacity."""
    alone, rest = 0, sum(sizes)
    while alone < bins - 1 and alone < len(sizes) and sizes[alone] * (bins - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    left = bins - alone
    packed = best_fit_decreasing(sizes[alone:], -(-rest // left), left)
    return [*range(alone), *(alone + b for b in packed)]


def document_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row in one of ``shards`` shards of near-equal bytes.

    Equal texts share a shard; a null text counts as an empty one. A group
    larger than a shard's share fills a shard of its own. ``slot`` numbers a
    shard's rows from 0 without gaps. Ties in size go by the group's hash, so
    the result does not depend on partitioning. Rows that repeat an id keep
    one slot each as long as the texts or sizes differ; an empty table gives
    no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = store(docs.select(
        F.col(id_col).alias("doc_id"), document_size(F.col(text_col)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("grp")), "rows")
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes"))
    total, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    parcel = max(1, -(-total // (shards * PARCELS_PER_SHARD)))
    tasks = max(1, -(-n_groups // GROUPS_PER_TASK))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "grp"], ascending=[False, True])
        frame["parcel"] = best_fit_decreasing(frame["bytes"].tolist(), parcel)
        return frame

    parcels = store(
        groups.withColumn("task", F.pmod(F.xxhash64("grp"), F.lit(tasks)).cast("int")).groupBy("task")
        .applyInPandas(pack, "grp binary, bytes long, task int, parcel long"), "parcels")
    # at most two parcels of half capacity for each of shards * PARCELS_PER_SHARD, and one more for each task
    sums = parcels.groupBy("task", "parcel").agg(F.sum("bytes").alias("bytes")).orderBy(
        F.desc("bytes"), "task", "parcel").collect()
    bins = level_bins([r["bytes"] for r in sums], shards)
    where = docs.sparkSession.createDataFrame(
        [(r["task"], r["parcel"], b) for r, b in zip(sums, bins)], "task int, parcel long, shard int")
    placed = parcels.join(F.broadcast(where), ["task", "parcel"]).select("grp", "shard")
    return numbered(
        rows.join(placed, "grp").select("doc_id", "size", "text_crc32", "shard"),
        ["shard"], ["doc_id", "text_crc32", "size"], "slot", slices_for(rows.count()))
