"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), nearest first.
Every pair of its ``head`` nearest pivots is a posting in an inverted list, so
two vectors meet in a list if they share two of those. For the vectors of a list
the pivots that two of them share among their ``prefix`` nearest are counted,
and only pairs that share at least ``shared`` are retrieved; these are verified
by the cosine in double precision. The pivots are a bounded sample;
all vectors are indexed. Recall against brute force is tested (README).

Equal vectors are one class. A list longer than ``MAX_LIST`` is compared block
by block in tasks of its own; nothing is dropped. Tasks return, for each
vector, its number of links and one edge to its group, never the pairs.
"""

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import components, store

#: vectors compared at once, and bytes of vectors that one task holds
MAX_LIST, TASK_BYTES = 4096, 32 << 20


def usable(vector) -> F.Column:
    """Neither null nor empty nor zero, all components finite numbers."""
    x = vector.cast("array<double>")
    return F.coalesce(
        F.exists(x, lambda v: v != 0)
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))), F.lit(False))


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, "float64") for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny components stay in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _key_table(prefix, head):
    """Smallest and second smallest pivot of every pair among the first ``head``."""
    first = np.sort(prefix[:, :head], axis=1)
    i, j = np.array([*combinations(range(first.shape[1]), 2)] or np.empty((0, 2), int)).reshape(-1, 2).T
    return first[:, i], first[:, j]


def _union(parent, a, b):
    while parent[a] != a:
        parent[a] = a = parent[parent[a]]
    while parent[b] != b:
        parent[b] = b = parent[parent[b]]
    if a != b:
        parent[max(a, b)] = min(a, b)


def _pivot_bits(prefix):
    """The nearest pivots of every vector as bits of 64-bit words."""
    bits = np.zeros((len(prefix), int(prefix.max(initial=0)) // 64 + 1), "uint64")
    for column in prefix.T:
        bits[np.arange(len(prefix)), column >> 6] |= np.uint64(1) << (column & 63).astype("uint64")
    return bits


def _compare(unit, bits, prefix, head, shared, least, left, right, key):
    """Pairs (of row numbers, left x right or within left) that the index
    retrieves by ``key`` first and whose cosine is at least ``least``."""
    first = np.sort(prefix[:, :head], axis=1)
    for at in range(0, len(left), 512):
        block = left[at:at + 512]
        count = sum(np.bitwise_count(bits[block, w][:, None] & bits[right, w]) for w in range(bits.shape[1]))
        a, b = np.nonzero(count >= shared)
        a, b = block[a], right[b]
        if left is right:
            a, b = a[a < b], b[a < b]
        for some in range(0, len(a), 1 << 16):
            x, y = a[some:some + (1 << 16)], b[some:some + (1 << 16)]
            alike = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
            x, y = x[alike], y[alike]
            # of the lists that hold both, only that of their two smallest common pivots counts the pair
            common = (first[x][:, :, None] == first[y][:, None, :]).any(2)
            order = np.cumsum(common, axis=1)
            low = first[x][np.arange(len(x)), (common & (order == 1)).argmax(1)]
            high = first[x][np.arange(len(x)), (common & (order == 2)).argmax(1)]
            own = (low == key[0]) & (high == key[1])
            yield x[own], y[own]


def _hashed(vector) -> list:
    """Two columns that name a vector in a join."""
    return [F.xxhash64(vector).alias("h"), F.xxhash64(vector, F.lit(1)).alias("h2")]


def near_duplicates(table: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
                    pivots: int = 128, prefix: int = 12, head: int = 6, shared: int = 4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Pairs with a cosine of at least ``least`` that the index retrieves are
    links; equal vectors always are. Vectors that are null, empty, zero or hold
    nulls, NaN or infinities link with nothing; vectors of different lengths
    neither. Ids are taken as unique; a repeated row (same id, same vector)
    counts as one more copy. No rows: no rows. Other columns are ignored.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vec"))
    good = usable(F.col("vec"))
    classes = store(
        rows.where(good).groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("dim", F.size("vec")), "classes")

    # the sample: the smallest hashes of each vector length; short of distinct pivots, all of them
    dims = [r[0] for r in classes.select("dim").distinct().collect()]
    chosen = {
        d: _unit([r["vec"] for r in classes.where(F.col("dim") == d).orderBy(F.xxhash64("rep"), "rep")
                  .select("vec").limit(pivots).collect()]) for d in dims}
    sent = spark.sparkContext.broadcast(chosen)

    @F.pandas_udf("array<int>")
    def nearest(vec: pd.Series) -> pd.Series:
        out = np.empty(len(vec), object)
        sizes = vec.map(len).to_numpy()
        for d in np.unique(sizes):
            at = np.nonzero(sizes == d)[0]
            reference = sent.value[d]
            order = np.argsort(-(_unit(vec.iloc[at]) @ reference.T), axis=1, kind="stable")[:, :prefix]
            for k, row in zip(at, order):
                out[k] = row
        return pd.Series(out)

    indexed = store(classes.withColumn("near", nearest("vec")), "indexed")
    firsts = F.array_sort(F.slice("near", 1, head))
    # with fewer than two pivots there is one list for all
    pairs = F.when(F.size("near") < 2, F.array(F.struct(F.col("near")[0].alias("p"), F.col("near")[0].alias("q")))) \
        .otherwise(F.flatten(F.transform(firsts, lambda p: F.transform(
            F.filter(firsts, lambda q: q > p), lambda q: F.struct(p.alias("p"), q.alias("q"))))))
    postings = indexed.select("rep", "dim", F.explode(pairs).alias("k")).select("rep", "dim", "k.p", "k.q")

    # at most pivots² / 2 lists for each vector length: their sizes decide who compares what
    sizes = postings.groupBy("dim", "p", "q").count().where("count > 1").orderBy("dim", "p", "q").collect()
    lists, task, held = [], 0, 0
    for r in sizes:
        most = max(256, min(MAX_LIST, TASK_BYTES // (16 * r["dim"])))
        if r["count"] > most:
            chunks = -(-r["count"] // most)
            lists.append((r["dim"], r["p"], r["q"], -1, chunks))
            continue
        if held and (held + r["count"]) * 8 * r["dim"] > TASK_BYTES:
            task, held = task + 1, 0
        held += r["count"]
        lists.append((r["dim"], r["p"], r["q"], task, 1))
    plan = F.broadcast(spark.createDataFrame(lists, "dim int, p int, q int, task int, chunks int"))
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
        F.least(F.col("chunk"), o).alias("i"), F.greatest(F.col("chunk"), o).alias("j")))
    dealt = (
        postings.join(plan, ["dim", "p", "q"]).withColumn("chunk", chunk)
        .select("rep", "dim", "task", F.when(F.col("task") < 0, F.col("p")).alias("p"),
                F.when(F.col("task") < 0, F.col("q")).alias("q"), "chunk",
                F.explode(F.when(F.col("task") < 0, others).otherwise(
                    F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))).alias("b"))
        .select("rep", "dim", "task", "p", "q", "b.i", "b.j", F.when(F.col("task") < 0, F.col("chunk")).alias("chunk"))
        .distinct()
    )
    held_keys = spark.sparkContext.broadcast({(d, p, q): t for d, p, q, t, _ in lists if t >= 0})

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep", ignore_index=True)
        unit, near = _unit(frame["vec"]), np.stack(frame["near"].to_numpy())
        bits = _pivot_bits(near)
        rep, copies = frame["rep"].to_numpy(), frame["copies"].to_numpy()
        dim, task = int(frame["dim"][0]), int(frame["task"][0])
        wanted, least_shared = min(shared, near.shape[1]), min(2, near.shape[1])
        found = []
        if near.shape[1] < 2:
            low = high = near[:, :1]
        else:
            low, high = _key_table(near, head)
        if task < 0:
            part = frame["chunk"].to_numpy()
            left = np.nonzero(part == frame["i"][0])[0]
            right = left if frame["i"][0] == frame["j"][0] else np.nonzero(part == frame["j"][0])[0]
            work = [((int(frame["p"][0]), int(frame["q"][0])), left, right)]
        else:
            codes = low.astype("int64") * (1 << 20) + high
            member = np.repeat(np.arange(len(frame)), codes.shape[1])
            flat = codes.ravel()
            order = np.argsort(flat, kind="stable")
            flat, member = flat[order], member[order]
            ends = np.nonzero(np.diff(flat, append=-1))[0] + 1
            work, at = [], 0
            for end in ends:
                key = (int(flat[at]) >> 20, int(flat[at]) & ((1 << 20) - 1))
                if end - at > 1 and held_keys.value.get((dim, *key)) == task:
                    work.append((key, member[at:end], member[at:end]))
                at = end
            work = [(k, m, m) for k, m, _ in work]
        for key, left, right in work:
            if least_shared < 2:
                cos = unit[left] @ unit[right].T >= least
                a, b = np.nonzero(np.triu(cos, 1) if left is right else cos)
                found.append((left[a], right[b]))
            else:
                found.extend(_compare(unit, bits, near, head, wanted, least, left, right, key))
        links, parent = np.zeros(len(frame), "int64"), list(range(len(frame)))
        for a, b in found:
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            for x, y in zip(a.tolist(), b.tolist()):
                _union(parent, x, y)
        some = np.nonzero(links)[0]
        to = []
        for x in some:
            while parent[x] != x:
                x = parent[x]
            to.append(rep[x])
        return pd.DataFrame({"rep": rep[some], "links": links[some], "link_to": to})

    vectors = indexed.select("rep", "copies", "vec", "near")
    linked = store(
        dealt.join(vectors, "rep")
        .groupBy("task", "dim", "p", "q", "i", "j")
        .applyInPandas(compare, "rep long, links long, link_to long"), "linked")
    totals = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    found = components(linked.select(F.col("rep").alias("a"), F.col("link_to").alias("b"))).select(
        F.col("node").alias("rep"), "component")
    by_class = (
        classes.select("vec", "rep", "copies").join(totals, "rep", "left").join(found, "rep", "left")
        .select(*_hashed("vec"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id")))
    return (
        rows.where(good).select("vec_id", *_hashed("vec")).join(by_class, ["h", "h2"])
        .select("vec_id", "n_links", "component_id")
        .unionByName(rows.where(~good).select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
