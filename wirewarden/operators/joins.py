"""Joins of a skewed fact side with a keyed side, and model lookups."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut

BROADCAST_BYTES = 64 << 20
SALTS = 32
#: a key with more than one of so many fact rows is hot, so there are fewer hot keys than this
HOT_KEYS = 1024
#: keys that a sketch of a task follows; a key is missed only below 7 / SKETCH_KEYS of the rows, under half of hot
SKETCH_KEYS = 16384


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(24)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
            return F.greatest(F.size(value), F.lit(0)) * 8 + F.lit(24)
        return F.coalesce(F.aggregate(
            value, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, kind.elementType)), F.lit(0)) + F.lit(24)
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def sent_bytes(df: DataFrame) -> int:
    """Size of the columns of ``df``, which is stored, by one aggregation."""
    row = sum((_bytes(F.col(f.name), f.dataType).cast("long") for f in df.schema), F.lit(16).cast("long"))
    return df.agg(F.sum(row)).first()[0] or 0


def join_keyed(facts: DataFrame, keyed: DataFrame, on, spread: Column, limit: int = BROADCAST_BYTES,
               salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Equi-join (inner, left_semi, left_anti) that survives a hot key on the ``facts`` side.

    ``keyed`` must be a stored table or a checkpoint: its size is measured by one
    aggregation over all its columns. Up to ``limit`` it is broadcast and the
    facts do not move. Beyond it both sides are shuffled on the key. A frequency
    sketch over the facts' keys names the hot ones; these alone are copied
    ``salts`` times, and ``spread`` chooses the copy that a fact row meets, so
    the rows of a hot key are divided over ``salts`` tasks and every other key
    is sent once. ``facts`` are read twice then and should be stored; those of a
    stream can't be, and all their keys count as hot.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if sent_bytes(keyed) <= limit:
        return facts.join(F.broadcast(keyed), keys, how)
    # one hash on both sides, whatever type a side keeps its keys in
    key = F.xxhash64(*[F.col(k).cast(keyed.schema[k].dataType) for k in keys])
    if facts.isStreaming:
        hot = F.lit(True)
    else:
        named = hot_keys(facts.select(key.alias("_key")))
        if not named:
            return facts.join(keyed.hint("merge"), keys, how)
        hot = key.isin(named)
    salt = F.when(hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    sent = keyed.withColumn("_salt", F.explode(copies))
    return facts.withColumn("_salt", salt).join(sent.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def hot_keys(hashes: DataFrame) -> list[int]:
    """The values of the one long column ``hashes`` that hold more than a HOT_KEYS-th of the rows.

    A sketch of each task is merged, so no row moves; a count may be an
    overestimate, which makes a key hot that isn't and costs its copies.
    """
    (column,) = hashes.columns
    found, rows = hashes.agg(
        F.expr(f"approx_top_k({column}, {HOT_KEYS}, {SKETCH_KEYS})"), F.count(F.lit(1))).first()
    return [r["item"] for r in found if r["count"] * HOT_KEYS > rows]


def model_bytes() -> Column:
    """Size of a model's four arrays before there is one: k*k transitions, k-vectors, keys."""
    k = F.col("n_components")
    return k * k * 8 + k * 64 + F.lit(400)


def latest_models(models: DataFrame) -> DataFrame:
    """One row per parameter: the last trained, then the highest version.

    An aggregate, not a ranking window: partial results meet before the
    shuffle, however many versions a parameter has.
    """
    rank = F.struct(F.coalesce("trained_at", F.timestamp_micros(F.lit(0))), F.coalesce("model_version", F.lit("")))
    rest = [c for c in models.columns if c != "p_id"]
    best = models.groupBy("p_id").agg(F.max_by(F.struct(*rest), rank).alias("_m"))
    return best.select("p_id", *[F.col(f"_m.{c}").alias(c) for c in rest])


def join_models(features: DataFrame, models: DataFrame, limit=BROADCAST_BYTES, salts=SALTS) -> DataFrame:
    """Each observation with its model; observations without one are dropped.

    The p_type and p_name of the result are the model's. Observations are
    spread by their record where they have one, since a parameter may have a
    single sequence, else by their sequence.
    """
    facts = features.drop(*({"p_type", "p_name"} & set(models.columns)))
    return join_keyed(facts, models, "p_id", _spread(features), limit, salts)


def _spread(features: DataFrame) -> Column:
    return F.col("record_id" if "record_id" in features.columns else "symbols")


def _keys(models: DataFrame) -> DataFrame:
    return cut(models.select("p_id").distinct())


def modelled(features: DataFrame, models: DataFrame, limit=BROADCAST_BYTES, salts=SALTS) -> DataFrame:
    return join_keyed(features, _keys(models), "p_id", _spread(features), limit, salts, "left_semi")


def unmodelled(features: DataFrame, models: DataFrame, limit=BROADCAST_BYTES, salts=SALTS) -> DataFrame:
    """Observations, or grouped sequences, of parameters without a model."""
    return join_keyed(features, _keys(models), "p_id", _spread(features), limit, salts, "left_anti")
