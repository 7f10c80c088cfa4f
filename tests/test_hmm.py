"""Likelihood, EM and the ways a model is trained."""

import itertools
import math
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wirewarden.operators import hmm
from wirewarden.operators.joins import hot_keys, join_keyed, join_models, latest_models
from wirewarden.operators.scoring import score, with_score_parameters
from wirewarden.operators.training import fit_large
from wirewarden.operators.thresholds import score_profiles
from wirewarden.plans.options import TrainOptions
from wirewarden.plans.train import train_groups, train_sequences
from wirewarden.session import cut


def random_model(rng, k):
    def rows(shape):
        m = rng.random(shape) + 0.05
        return m / m.sum(axis=-1, keepdims=True)
    return rows(k), rows((k, k)), rng.choice([65.0, 78.0, 47.0, 0.0], k) + rng.random(k), rng.random(k) * 3 + 0.1


def model_row(key, model):
    start, trans, means, variances = (np.asarray(a, float).tolist() for a in model)
    return key, len(start), start, trans, means, variances


MODEL_DDL = "p_id string, n_components int, startprob array<double>, transmat array<array<double>>, means array<double>, vars array<double>"


def native_scores(spark, pairs):
    rows = [(*model_row(str(i), m), s) for i, (m, s) in enumerate(pairs)]
    df = spark.createDataFrame(rows, MODEL_DDL + ", symbols string")
    return [r.score for r in score(with_score_parameters(df)).orderBy(F.col("p_id").cast("int")).collect()]


def by_all_paths(model, x):
    """Sum over every hidden path, by definition."""
    start, trans, means, variances = model
    logs = []
    for path in itertools.product(range(len(start)), repeat=len(x)):
        p = start[path[0]] * math.prod(trans[a][b] for a, b in zip(path, path[1:]))
        if p > 0:
            dens = sum(-0.5 * (math.log(2 * math.pi * variances[s]) + (o - means[s]) ** 2 / variances[s]) for s, o in zip(path, x))
            logs.append(math.log(p) + dens)
    top = max(logs, default=-math.inf)
    return top + math.log(sum(math.exp(v - top) for v in logs)) if logs else -math.inf


def test_scores_equal_sum_over_paths(spark):
    rng = np.random.default_rng(1)
    pairs = []
    for k in (1, 2, 3, 4):
        for text in ("A", "\x00", "AN", "NAN/", "/A中N", "NNAAN"):
            pairs.append((random_model(rng, k), text))
    impossible = ([1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], [78.0, 65.0], [1e-5, 1e-5])
    pairs += [(impossible, "NA"), (impossible, "AAN"), (impossible, "NNN"), ([[0.0, 1.0], *impossible[1:]], "NA")]
    wanted = [by_all_paths(m, [ord(c) for c in s]) for m, s in pairs]
    assert native_scores(spark, pairs) == pytest.approx(wanted, rel=1e-9, abs=1e-9)
    assert [float(hmm.scores(tuple(map(np.asarray, m)), [s])[0]) for m, s in pairs] == pytest.approx(wanted, rel=1e-9, abs=1e-9)


def test_long_sequences_native_equals_numpy(spark):
    rng = np.random.default_rng(2)
    pairs = [(random_model(rng, k), "".join(rng.choice(list("ANAN/%-"), 300))) for k in (1, 2, 3, 6)]
    wanted = [float(hmm.scores(m, [s])[0]) for m, s in pairs]
    assert native_scores(spark, pairs) == pytest.approx(wanted, rel=1e-10)


SEQUENCES = st.dictionaries(st.text(st.sampled_from("AN/-中"), min_size=1, max_size=8), st.integers(1, 20), min_size=1, max_size=12)


@settings(max_examples=40, deadline=None)
@given(SEQUENCES)
def test_em_properties(weighted):
    symbols, weights = list(weighted), np.array(list(weighted.values()))
    k = hmm.mean_distinct(symbols, weights)
    parts = list(hmm.blocks(symbols, weights, k))
    values = np.array([ord(c) for s, w in weighted.items() for c in s for _ in range(w)], float)
    model, liks = hmm.initial_model(*np.unique(values, return_counts=True), k), []
    for _ in range(15):
        sums = hmm.as_sums(sum(hmm.expectation(model, x, w)[0] for _, x, w in parts))
        # EM raises the likelihood penalised by the variance prior
        liks.append(sums[0] - (hmm.COVAR_PRIOR / (2 * model[3])).sum())
        model = hmm.maximisation(model, sums)
    assert all(b >= a - 1e-7 * (1 + abs(a)) for a, b in zip(liks, liks[1:]))
    (start, trans, means, variances), _, n_iter, _ = hmm.fit(symbols, weights, k)
    assert start.sum() == pytest.approx(1) and trans.sum(axis=1) == pytest.approx(np.ones(k))
    assert (variances > 0).all() and n_iter <= hmm.MAX_ITER
    # weights are repetitions, and the order of sequences is irrelevant
    repeated = [s for s, w in reversed(weighted.items()) for _ in range(w)]
    again = hmm.fit(repeated, np.ones(len(repeated)), k)[0]
    assert again[2] == pytest.approx(means, rel=1e-6)


def test_zero_rows_are_repaired():
    fixed = hmm.repair(np.array([[0.0, 0.0, 0.0], [0.2, 0.8, 0.0], [0.0, 0.0, 0.0]]))
    assert fixed.tolist() == [[1 / 3] * 3, [0.2, 0.8, 0.0], [1 / 3] * 3]


def test_constant_parameter_has_one_tight_state():
    (start, trans, means, variances), *_ = hmm.fit(["AAA"], [50], 1)
    assert means.tolist() == [65.0] and variances == pytest.approx([hmm.COVAR_PRIOR / 150])


def sequences_frame(spark, groups):
    rows = [(p, s, "uri", p, int(w), 7) for p, seqs in groups.items() for s, w in seqs.items()]
    return cut(spark.createDataFrame(rows, "p_id string, symbols string, p_type string, p_name string, weight bigint, first_time bigint"))


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    def texts(alphabet, n, low, high):
        out = {}
        for _ in range(n):
            s = "".join(rng.choice(list(alphabet), rng.integers(low, high)))
            out[s] = out.get(s, 0) + 1
        return out
    return {"hex": texts("AANN", 60, 8, 12), "num": texts("NNNNNNNN.", 40, 2, 6), "path": texts("/AAA", 30, 3, 9),
            "const": {"AAAAAAA": 40}, "rare": {"A": 9}}


def model_values(models):
    return {r.p_id: r for r in models.collect()}


def test_a_model_per_supported_parameter_and_no_training_alarm(spark, groups):
    sequences = sequences_frame(spark, groups)
    models = cut(train_sequences(sequences))
    assert set(model_values(models)) == {"hex", "num", "path", "const"}
    side = with_score_parameters(models)
    scored = score(join_models(sequences, side))
    assert scored.where("score < profile").count() == 0
    assert scored.where("score = profile").select("p_id").distinct().count() == 4


def test_chunked_training_equals_one_task(spark, groups):
    """A parameter that exceeds one task is trained by the distributed EM."""
    sequences = sequences_frame(spark, groups)
    one = model_values(train_sequences(sequences))
    many = model_values(train_sequences(sequences, TrainOptions(group_cells=150)))
    assert set(one) == set(many)
    for key, a in one.items():
        b = many[key]
        assert (a.n_components, a.n_iter, a.converged) == (b.n_components, b.n_iter, b.converged)
        # the same bits, not only the same numbers up to rounding
        for field in ("means", "vars", "startprob", "transmat", "profile"):
            assert getattr(b, field) == getattr(a, field)
        assert (b.score_mean, b.score_std) == pytest.approx((a.score_mean, a.score_std), rel=1e-9, abs=1e-9)
    spread = model_values(train_sequences(cut(sequences.repartition(5, "symbols")), TrainOptions(group_cells=150)))
    assert all(spread[k].means == one[k].means and spread[k].transmat == one[k].transmat for k in one)
    capped = model_values(train_sequences(sequences, TrainOptions(max_iter=1)))
    assert all(r.n_iter == 1 and not r.converged for r in capped.values())


def test_waves_change_nothing(spark, groups):
    """Models that exceed the driver's bound are trained in several waves."""
    sequences = sequences_frame(spark, groups)
    stats = cut(train_groups(sequences))
    one, many = model_values(fit_large(sequences, stats)), model_values(fit_large(sequences, stats, wave_bytes=1000))
    assert set(one) == set(many) == {"hex", "num", "path", "const"}
    for key, a in one.items():
        assert many[key].means == pytest.approx(a.means, rel=1e-9) and many[key].n_iter == a.n_iter


def outlier_groups():
    return {"p": {"NN": 60, "NNN": 55, "NNNN": 50, "A/A/A<A>": 1, "'A'='A'": 1}, "q": {"AA": 30, "AAA": 25, "///////": 1}}


def test_robust_training_drops_outliers_by_either_path(spark):
    sequences = sequences_frame(spark, outlier_groups())
    plain = model_values(train_sequences(sequences))
    one = model_values(train_sequences(sequences, TrainOptions(robust=True)))
    many = model_values(train_sequences(sequences, TrainOptions(robust=True, group_cells=20)))
    assert plain["p"].n_seq == 167 and one["p"].n_seq < 167
    for key, a in one.items():
        assert a.profile > plain[key].profile
        assert not a.profile < a.score_mean - 3 * a.score_std - 1e-9
        assert (many[key].n_seq, many[key].n_components) == (a.n_seq, a.n_components)
        assert many[key].profile == pytest.approx(a.profile, rel=1e-6)


def dropped_by_whole_fits(group):
    """Three-sigma retraining with a whole fit for every dropped occurrence: (model, kept, drops)."""
    symbols, weights, drops = list(group), np.array(list(group.values()), dtype=np.int64), 0
    while True:
        result = hmm.fit(symbols, weights, hmm.mean_distinct(symbols, weights))
        found = hmm.scores(result[0], symbols)
        if not hmm.outside_three_sigma(found, weights):
            return result, dict(zip(symbols, weights.tolist())), drops
        worst = min(range(len(symbols)), key=lambda i: (found[i], symbols[i]))
        weights[worst] -= 1
        drops += 1
        if not weights[worst]:
            del symbols[worst]
            weights = np.delete(weights, worst)


def many_outliers():
    rng = np.random.default_rng(4)
    group = {"".join(rng.choice(list("AN"), rng.integers(4, 9))): int(rng.integers(20, 60)) for _ in range(60)}
    return group | {"<A>": 3, "A'A": 2, "A=A;A": 2, "/A/..": 4, "N%N%N%": 1}


@pytest.mark.parametrize("group", [many_outliers(), *outlier_groups().values()])
def test_dropping_goes_on_from_the_sums_before(monkeypatch, group):
    """The same occurrences go as with whole fits, and the same model comes out, with fewer fits than drops."""
    wanted, kept, drops = dropped_by_whole_fits(group)
    fits, first = [], hmm.first_model
    monkeypatch.setattr(hmm, "first_model", lambda *a: fits.append(1) or first(*a))
    result, symbols, weights = hmm.fit_robust(list(group), list(group.values()))
    assert dict(zip(symbols, weights.tolist())) == kept and drops > 0
    assert all((a == b).all() for a, b in zip(result[0], wanted[0])) and result[1:] == wanted[1:]
    if drops > 5:
        assert len(fits) < drops


def overlapping(seed, k):
    """Sequences of a chain over six symbols, whose states can't be told apart early."""
    rng = np.random.default_rng(seed)
    steps, found = rng.dirichlet(np.full(6, 0.6), 6), set()
    for _ in range(80):
        at = [int(rng.integers(6))]
        for _ in range(rng.integers(4, 30)):
            at.append(int(rng.choice(6, p=steps[at[-1]])))
        found.add("".join("ANC/<="[i] for i in at))
    symbols = sorted(found)
    return symbols, rng.integers(1, 20, len(symbols)), k


def test_accelerated_em_needs_fewer_rounds_and_loses_no_likelihood():
    def rounds_and_likelihood(symbols, weights, k, **more):
        model, _, n_iter, converged = hmm.fit(symbols, weights, k, **more)
        assert converged
        return n_iter, float((hmm.scores(model, symbols) * weights).sum())
    plain, fast = [], []
    for seed in range(24):
        group = overlapping(seed, 2 + seed % 4)
        plain.append(rounds_and_likelihood(*group))
        fast.append(rounds_and_likelihood(*group, accelerate=True))
        assert fast[-1][1] > plain[-1][1] - 2 * hmm.TOLERANCE
    slow = [i for i, (n, _) in enumerate(plain) if n >= 40]
    assert slow and sum(fast[i][0] for i in slow) <= 0.7 * sum(plain[i][0] for i in slow)
    assert sum(n for n, _ in fast) < sum(n for n, _ in plain)


def test_accelerated_em_never_falls_and_keeps_distributions():
    symbols, weights, k = overlapping(8, 2)
    parts = list(hmm.blocks(symbols, weights, k))
    ascent, seen, jumps, done = hmm.Ascent(hmm.first_model(parts, k), accelerate=True), [], 0, False
    while not done:
        before = ascent.model
        assert before[0].sum() == pytest.approx(1) and before[1].sum(axis=1) == pytest.approx(1)
        assert (before[0] >= 0).all() and (before[1] >= 0).all() and (before[3] > 0).all()
        done = ascent.take(hmm.as_sums(sum(hmm.expectation(before, x, w)[0] for _, x, w in parts)))
        jumps += ascent._fallback is not None
        seen.append(ascent.loglik)
    assert jumps and seen == sorted(seen)
    # a leap that loses is taken back: EM goes on from the step before it
    ascent = hmm.Ascent(hmm.first_model(parts, k), accelerate=True)
    while ascent._fallback is None:
        ascent.take(hmm.as_sums(sum(hmm.expectation(ascent.model, x, w)[0] for _, x, w in parts)))
    step, known = ascent._fallback, ascent.loglik
    sums = hmm.as_sums(sum(hmm.expectation(step, x, w)[0] for _, x, w in parts))
    sums[0] = known - 1
    assert not ascent.take(sums) and ascent.model is step and ascent.loglik == known


def test_accelerated_training_is_the_same_on_both_paths(spark, groups):
    symbols, weights, _ = overlapping(8, 2)
    sequences = sequences_frame(spark, groups | {"slow": dict(zip(symbols, map(int, weights)))})
    one = model_values(train_sequences(sequences, TrainOptions(accelerate=True)))
    many = model_values(train_sequences(sequences, TrainOptions(accelerate=True, group_cells=150)))
    for key, a in one.items():
        assert all(getattr(many[key], f) == getattr(a, f) for f in ("n_iter", "converged", "means", "vars", "startprob", "transmat", "profile"))


def test_sums_less_a_dropped_share_are_the_sums_without_it():
    group = many_outliers()
    symbols, weights = list(group), np.array(list(group.values()))
    model = hmm.fit(symbols, weights, 2)[0]
    whole, share = hmm.added_sums(model, symbols, weights)[0], hmm.added_sums(model, symbols[-1:], np.ones(1))[0]
    weights[-1] -= 1
    assert (whole - share == hmm.added_sums(model, symbols, weights)[0]).all()


def test_training_ignores_partitioning(spark, groups):
    sequences = sequences_frame(spark, groups)
    a = model_values(train_sequences(sequences))
    b = model_values(train_sequences(cut(sequences.repartition(7, "symbols"))))
    assert {k: (r.means, r.vars, r.transmat, r.profile) for k, r in a.items()} == {k: (r.means, r.vars, r.transmat, r.profile) for k, r in b.items()}


def test_profiles_are_weighted_and_exact(spark):
    rows = [("a", -1000000.25, 3, -1e6), ("a", -1000000.75, 1, -1e6), ("b", -0.1, 7, 0.0)]
    got = {r.p_id: r for r in score_profiles(spark.createDataFrame(rows, "p_id string, score double, weight bigint, center double")).collect()}
    data = [-1000000.25] * 3 + [-1000000.75]
    assert (got["a"].profile, got["a"].score_mean) == (-1000000.75, pytest.approx(np.mean(data), abs=1e-9))
    assert got["a"].score_std == pytest.approx(np.std(data), rel=1e-9)
    assert (got["b"].profile, got["b"].score_mean, got["b"].score_std) == (-0.1, -0.1, 0.0)


def test_group_label_and_hidden_states(spark):
    rows = [("p", "AN", "uri", "x", 3, 20), ("p", "A", "cookie", "x", 9, 10), ("p", "AN/", "post", "x", 1, 10)]
    df = spark.createDataFrame(rows, "p_id string, symbols string, p_type string, p_name string, weight bigint, first_time bigint")
    (r,) = train_groups(df).collect()
    # the earliest, ties to the smaller type; (3*2 + 9*1 + 1*3) / 13 = 1.38
    assert (r.p_type, r.n_seq, r.n_components) == ("cookie", 13, 1)


def test_salted_join_equals_broadcast_join(spark):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    keyed = cut(facts.select("k").distinct().where("k <> 'k7'").withColumn("v", F.length("k")))
    def run(limit):
        joined = join_keyed(facts, keyed, "k", F.col("id"), limit=limit, salts=8)
        return joined, sorted(map(tuple, joined.select("id", "k", "v").collect()))
    broadcast, a = run(1 << 20)
    salted, b = run(0)
    assert a == b and len(a) > 2900
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and "BroadcastHashJoin" in broadcast._jdf.queryExecution().executedPlan().toString()


def test_only_hot_keys_are_copied(spark):
    # 9,000 keys of one row and one of 3,000, beside a key that no fact has; keys are int here and bigint there
    facts = cut(spark.range(12_000).select(
        F.when(F.col("id") < 3000, F.lit(-1)).otherwise(F.col("id")).cast("int").alias("k"), "id"))
    keyed = cut(facts.select(F.col("k").cast("bigint").alias("k")).distinct().where("k % 10 <> 0")
                .unionByName(spark.range(-2, -1).select(F.col("id").alias("k"))).withColumn("v", F.col("k") * 2))
    for how in ("inner", "left_semi", "left_anti"):
        wanted = sorted(map(tuple, join_keyed(facts, keyed, "k", F.col("id"), how=how).select("id", "k").collect()))
        joined = join_keyed(facts, keyed, "k", F.col("id"), limit=0, salts=8, how=how)
        assert sorted(map(tuple, joined.select("id", "k").collect())) == wanted
    hashed = hot_keys(facts.select(F.xxhash64(F.col("k").cast("bigint")).alias("h")))
    assert hashed == [r.h for r in spark.range(1).select(F.xxhash64(F.lit(-1).cast("bigint")).alias("h")).collect()]
    salted = join_keyed(facts, keyed, "k", F.col("id"), limit=0, salts=8)
    generate = next(line for line in salted._jdf.queryExecution().optimizedPlan().toString().splitlines() if "explode" in line)
    assert "CASE WHEN" in generate
    # all but the hot key are sent once, and without a hot key nothing is salted
    cold = facts.where("k >= 0")
    assert hot_keys(cold.select(F.xxhash64("k").alias("h"))) == [] and hot_keys(cold.limit(0).select(F.col("id").alias("h"))) == []
    plain = join_keyed(cold, keyed, "k", F.col("id"), limit=0, salts=8)
    assert "_salt" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert plain.count() == cold.join(keyed, "k").count()


def test_x24_latest_version_wins(spark):
    rows = [("a", "1", "2024-01-01 00:00:00", 1), ("a", "2", "2024-01-02 00:00:00", 2), ("a", "3", "2024-01-02 00:00:00", 3), ("b", "1", None, 4)]
    df = spark.createDataFrame(rows, "p_id string, model_version string, t string, n int")
    got = latest_models(df.withColumn("trained_at", F.to_timestamp("t"))).orderBy("p_id").collect()
    assert [(r.p_id, r.n) for r in got] == [("a", 3), ("b", 4)]


def test_dropping_reads_the_sequences_once(monkeypatch):
    """A drop changes a weight or takes a row out; the sequences are cut into blocks again for another number of states only."""
    cuts, blocks = [], hmm.blocks
    monkeypatch.setattr(hmm, "blocks", lambda symbols, weights, k: cuts.append(k) or blocks(symbols, weights, k))
    group = many_outliers()
    result, symbols, weights = hmm.fit_robust(list(group), list(group.values()))
    assert sum(group.values()) - weights.sum() > 1
    assert all(a != b for a, b in zip(cuts, cuts[1:]))


def test_fit_needs_memory_for_its_symbols_and_a_block():
    numbers = np.random.default_rng(5).integers(0, 2, (16000, 32))
    symbols = ["".join("AN"[i] for i in row) for row in numbers]
    tracemalloc.start()
    try:
        hmm.fit(symbols, np.ones(len(symbols)), 2, max_iter=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # the symbols are 4 MB as numbers; a block is 2 MB for each array over its symbols and states
    assert peak < 32 << 20


def test_first_model_counts_block_by_block():
    symbols, weights = ["AN.A", "NNNN", "A", "./", "AN"], [3, 1, 2, 7, 5]
    values, counts = np.unique(np.concatenate([np.repeat(hmm.codes(s), w) for s, w in zip(symbols, weights)]), return_counts=True)
    for k in (1, 2, 3):
        for found, wanted in zip(hmm.first_model(list(hmm.blocks(symbols, weights, k)), k), hmm.initial_model(values, counts, k)):
            assert np.array_equal(found, wanted)
