"""What several operators share: reading, stored intermediates, numbering, connected components."""

import ctypes
from contextlib import contextmanager
from functools import reduce

import pyarrow
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.joins import sent_bytes
from ..session import collect_garbage, discard, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Later steps read only the columns they need, and a lost executor costs
    no more than the tasks it ran.
    """
    return written(df, shared_path(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame, name: str):
    """The same for a table that is read inside the ``with`` alone: its files go at the end, and
    so do the shuffle files of what was stored before."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    yield written(df, path)
    discard(spark, path)
    collect_garbage(spark)


#: bytes of rows up to which a table is broadcast
BROADCAST_BYTES = 32 << 20
#: broadcasts that a table of ids beyond it may be divided into, so that whole texts are not shuffled
WAVES = 8


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows are measured to be small; else a join shuffles."""
    return F.broadcast(df) if sent_bytes(df) <= limit else df


def by_ids(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``docs`` joined (left_semi or left_anti) with a stored table of the ids ``key`` alone.

    Ids beyond a broadcast are divided by their hash, and so are the rows that meet them: a row is
    read a few times, but its text does not move. Only beyond ``WAVES`` broadcasts is it shuffled.
    """
    waves = max(1, -(-sent_bytes(ids) // BROADCAST_BYTES))
    if waves > WAVES:
        return docs.join(ids, key, how)
    if waves == 1:
        return docs.join(F.broadcast(ids), key, how)
    own = F.pmod(F.xxhash64(F.col(key).cast(ids.schema[key].dataType)), F.lit(waves))
    each = [docs.where(own == i).join(F.broadcast(ids.where(own == i)), key, how) for i in range(waves)]
    return reduce(DataFrame.unionByName, each)


def in_small_batches(df: DataFrame, rows: int = 1000, size: int = 4 << 20) -> DataFrame:
    """``df`` for a function in Python over whole texts: its session passes Arrow
    batches of few rows and bytes, as a worker holds several copies of one."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


def give_back():
    """Hand back memory that Arrow's pool and the C library keep for later: a
    worker lives on after its task, next to those of other stages."""
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def frugal(run):
    """``run`` over the batches of a task, giving memory back now and then and at the end."""

    def over(batches):
        for n, out in enumerate(run(batches)):
            yield out
            if n % 16 == 15:
                give_back()
        give_back()

    return over


def map_documents(docs: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over pandas batches of ``docs`` with ids as text, since pandas has
    no null among whole numbers; ``schema`` has the columns after doc_id."""
    kind = docs.schema["doc_id"].dataType
    named = in_small_batches(docs.withColumn("doc_id", F.col("doc_id").cast("string")))
    return named.mapInPandas(frugal(run), f"doc_id string, {schema}").withColumn("doc_id", F.col("doc_id").cast(kind))


def parts(frame, column: str = "text", most: int = 4 << 20):
    """A pandas batch in stretches of about ``most`` characters of ``column``, so
    that what is made of a batch stays small however long its texts are."""
    start = held = 0
    for at, text in enumerate(frame[column]):
        held += len(text) if text is not None else 0
        if held >= most:
            yield frame.iloc[start:at + 1]
            start, held = at + 1, 0
    if start < len(frame):
        yield frame.iloc[start:]


def slices_for(rows: int, per_slice: int = 200_000, least: int = 8) -> int:
    return max(least, -(-rows // per_slice))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, slices: int) -> DataFrame:
    """Gapless numbers from 0 within ``keys``, for a stored ``df``.

    A key is divided over ``slices`` by the hash of ``order`` (which must tell
    its rows apart), numbered in each slice and shifted by the running count of
    the slices before, so one key may hold most rows without meeting in a task.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    )
    own = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_rank", F.row_number().over(own) - 1)
        .join(bases, [*keys, "_slice"])
        .withColumn(name, (F.col("_base") + F.col("_rank")).cast("long"))
        .drop("_slice", "_rank", "_base")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge table; component is its smallest node.

    Alternating large and small stars: each round is one aggregation with a
    map-side minimum and one join per star, and the edge table only shrinks to
    a star for each component. Nodes without an edge don't appear.
    """
    current = store(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    last = None
    while True:
        # large star: every larger neighbour of a node joins the node's smallest neighbour or itself
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = current.join(least, current.lo == least.u).select(F.col("hi"), F.col("m").alias("lo")).distinct()
        large = large.where("hi <> lo")
        # small star: a node and its smaller neighbours join the smallest of them
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        moved = large.join(least, large.hi == least.u)
        small = (
            moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
            .where("hi <> lo").distinct()
        )
        current = store(small, "edges")
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
