"""Observations -> weighted distinct sequences -> parameter statistics."""

from pyspark.sql import DataFrame, Observation, functions as F

from ..functions import symbol_states

MIN_SEQUENCES = 10


def group_sequences(features: DataFrame) -> DataFrame:
    """Distinct sequences of each parameter with their number of occurrences.

    The likelihood depends on the multiset of sequences only. The group buffer
    holds two numbers, so Spark combines map-side in a hash table and a hot
    parameter reaches the shuffle as its distinct values, spread by value.
    """
    return features.groupBy("p_id", "symbols", "p_type", "p_name").agg(
        F.count("*").alias("weight"), F.min("flow_time").alias("first_time")
    )


def parameter_stats(sequences: DataFrame) -> DataFrame:
    """Per parameter: label, number of sequences, hidden states, total size.

    The label is that of the earliest observation, ties going to the smaller
    type and name. The number of hidden states is the mean number of distinct
    symbols per sequence, rounded half to even.
    """
    n_symbols = F.length("symbols")
    n_distinct = F.size(F.array_distinct(F.split("symbols", "")))
    measured = sequences.select(
        "p_id", "weight", "first_time", "p_type", "p_name",
        n_symbols.alias("n_symbols"), n_distinct.alias("n_distinct"),
    )
    # numbers first: labels repeat, so the label choice runs on few rows
    by_label = measured.groupBy("p_id", "p_type", "p_name").agg(
        F.min("first_time").alias("first_time"),
        F.sum("weight").alias("n_seq"),
        F.count("*").alias("n_rows"),
        F.sum("n_symbols").alias("stored_symbols"),
        F.sum(F.col("weight") * F.col("n_symbols")).alias("n_symbols"),
        F.sum(F.col("weight") * F.col("n_distinct")).alias("distinct_sum"),
    )
    return by_label.groupBy("p_id").agg(
        F.min_by(F.struct("p_type", "p_name"), F.struct("first_time", "p_type", "p_name")).alias("_label"),
        *[F.sum(c).alias(c) for c in ("n_seq", "n_rows", "stored_symbols", "n_symbols", "distinct_sum")],
    ).select(
        "p_id", F.col("_label.p_type").alias("p_type"), F.col("_label.p_name").alias("p_name"),
        "n_seq", "n_rows", "stored_symbols", "n_symbols",
        F.bround(F.col("distinct_sum") / F.col("n_seq")).cast("int").alias("n_components"),
    )


def with_min_support(stats: DataFrame, min_sequences: int = MIN_SEQUENCES) -> DataFrame:
    return stats.where(F.col("n_seq") >= min_sequences)


def train_counts(sequences: DataFrame, min_sequences: int = MIN_SEQUENCES) -> DataFrame:
    """One row: observations, parameters, parameters with enough of them."""
    per_parameter = sequences.groupBy("p_id").agg(F.sum("weight").alias("n_seq"))
    return per_parameter.agg(
        F.coalesce(F.sum("n_seq"), F.lit(0)).alias("n_features"),
        F.count("*").alias("n_parameters"),
        F.count_if(F.col("n_seq") >= min_sequences).alias("n_effective"),
    )


def sequence_stats(features: DataFrame) -> DataFrame:
    states = symbol_states(F.col("symbols"))
    return features.select(
        "*", F.size(states).alias("n_symbols"), F.size(F.array_distinct(states)).alias("n_distinct")
    )


def count_while_training(stats: DataFrame, counts: Observation, min_sequences: int = MIN_SEQUENCES) -> DataFrame:
    """The numbers of ``train_counts`` as metrics of whatever job computes ``stats``
    (a row for every parameter, those of too few sequences among them)."""
    return stats.observe(
        counts, F.coalesce(F.sum("n_seq"), F.lit(0)).alias("n_features"), F.count(F.lit(1)).alias("n_parameters"),
        F.count_if(F.col("n_seq") >= min_sequences).alias("n_effective"))
