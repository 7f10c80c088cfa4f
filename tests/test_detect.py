"""The scorer on every kind of model, and the plan of detection."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirewarden.operators import bodies
from wirewarden.operators.features import extract_features
from wirewarden.operators.joins import SALTS, join_keyed, modelled, sent_bytes, unmodelled
from wirewarden.plans import detect as plan
from wirewarden.plans.options import DetectOptions
from wirewarden.schemas import HTTP_FIELDS, HTTP_RECORD
from wirewarden.session import cut

from test_hmm import native_scores


def by_all_paths(model, x):
    """Sum over every hidden path, by definition; products as sums of logarithms, so that none underflows."""
    start, trans, means, variances = model
    logs = []
    for path in itertools.product(range(len(start)), repeat=len(x)):
        factors = [start[path[0]], *(trans[a][b] for a, b in zip(path, path[1:]))]
        if all(f > 0 for f in factors):
            logs.append(sum(map(math.log, factors)) - sum(
                (math.log(2 * math.pi * variances[s]) + (o - means[s]) ** 2 / variances[s]) / 2 for s, o in zip(path, x)))
    top = max(logs, default=-math.inf)
    return top + math.log(sum(math.exp(v - top) for v in logs)) if logs else -math.inf


def sparse_model(rng, k):
    """Zero rows, zero columns and entries down to 1e-300 among the transitions and starts."""
    trans = rng.random((k, k)) * 10.0 ** -rng.choice([0, 0, 5, 40, 300], (k, k))
    trans[:, rng.random(k) < 0.3] = 0
    trans[rng.random(k) < 0.2] = 0
    start = rng.random(k) * 10.0 ** -rng.choice([0, 0, 100, 300], k)
    start[rng.random(k) < 0.3] = 0
    if k == 1:  # one state is where it starts and stays
        start[:], trans[:] = 1, 1
    return start, trans, rng.choice([65.0, 78.0, 71.5, 47.0], k), rng.choice([0.1, 1.0, 50.0], k)


def test_every_model_scores_by_its_paths(spark):
    rng = np.random.default_rng(5)
    pairs = [(sparse_model(rng, k), text) for k in range(1, 7) for _ in range(12)
             for text in ("A", "NA", "AAN", "/N/", "NNN")]
    pairs.append((([0.5, 0.5], [[0, 1], [0, 1]], [65.0, 78.0], [1.0, 1.0]), "AN"))
    wanted = [by_all_paths(m, [ord(c) for c in s]) for m, s in pairs]
    assert native_scores(spark, pairs) == pytest.approx(wanted, rel=1e-9, abs=1e-9)
    assert wanted[-1] == pytest.approx(-2.5310, abs=1e-4)


@pytest.mark.parametrize("text,names", [
    ('{"a":1}', ["a"]), (' {"a":1,"b":{"c":2}} \n', ["a", "b"]), ("{}", []), ('{"a":1}garbage', None),
    ('{"a":1}{"b":2}', None), ('{"a":1}]x', None), ('{"a":1}}', None), ('{"a":1},{"b":2}', None), ('{"a":1}]', None),
    ('{"a":1', None), ("[1]", None), ("1", None), ("", None), ('{"a":1}}]', None), ('{"a":1},', None),
    ('{"a":1},"b":{"c":2}', None), ('{"a":1},"v":{"c":2}', None), ('{"a":1}},{"b":{"c":2}', None), ('{"a":1}},0]', None),
    ("{'a':1}", None), ("null", None), ('"x"', None), ('{"v":{"a":[1, 2]},"a":null}', ["v", "a"]), ('{"a":1,"a":2}', ["a", "a"]),
])
def test_a_json_body_is_one_object_and_nothing_else(spark, text, names):
    row = spark.createDataFrame([(text,)], "t string").select(bodies.json_pairs(F.col("t")).alias("p")).first()
    assert (row.p if row.p is None else [x["name"] for x in row.p]) == names


def requests(spark, n=10_000):
    return spark.range(n).select(
        F.col("id").cast("string").alias("record_id"),
        *[F.lit(1).cast("long").alias(f.name) if f.name == "flow_time" else F.lit({
            "method": "GET", "host": "h.example", "uri": "/a?v=12", "http_type": "Request"}.get(f.name, "")).alias(f.name)
          for f in HTTP_RECORD])


def models(spark, features):
    return cut(features.select("p_id", "p_type", "p_name").distinct().withColumns({
        "n_components": F.lit(1), "startprob": F.array(F.lit(1.0)), "transmat": F.array(F.array(F.lit(1.0))),
        "means": F.array(F.lit(78.0)), "vars": F.array(F.lit(1.0)), "profile": F.lit(0.0),
        "model_version": F.lit("1"), "trained_at": F.lit(None).cast("timestamp")}))


def test_a_key_with_one_sequence_spreads_over_all_salts(spark):
    features = extract_features(requests(spark)).where("p_type = 'http_type'")
    assert features.select("p_id", "symbols").distinct().count() == 1
    known = models(spark, features)
    joined = join_keyed(features, cut(known.select("p_id")), "p_id", F.col("record_id"), limit=0)
    plan_text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan_text and joined.count() == 10_000
    salts = features.select(F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).alias("s")).groupBy("s").count().collect()
    assert len(salts) == SALTS and max(r["count"] for r in salts) < 2 * 10_000 / SALTS


def test_bodies_stay_where_they_are_until_alarms_are_known(spark):
    records = requests(spark, 500)
    known = models(spark, extract_features(records))
    wanted = sorted(map(tuple, plan.detect(records, known).select("record_id", "p_id", "score", *HTTP_FIELDS).collect()))
    # a first reading gives 64 MB or nothing for broadcasts: alarms must be the same
    small = DetectOptions(broadcast_bytes=0)
    found = plan.detect(records, known, small)
    assert sorted(map(tuple, found.select("record_id", "p_id", "score", *HTTP_FIELDS).collect())) == wanted
    assert len(wanted) > 500
    scored = plan.score_requests(records, known, small, carry=("record_id",))
    # every exchange of the joined observations moves keys alone
    text = scored._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bdata#|\bcookie#", "".join(re.findall(r"Exchange hashpartitioning[^\n]*", text)))
    assert "_salt" in text


def test_repeated_records_give_the_same_alarms_on_both_ways(spark):
    """Records of an archive are keyed by their content, so equal ones share an id."""
    records = requests(spark, 7).drop("record_id")
    records = records.unionByName(requests(spark, 2).drop("record_id").withColumn("uri", F.lit("/b?v=7")))
    known = models(spark, extract_features(requests(spark, 1)))
    small, columns = DetectOptions(broadcast_bytes=0), ["record_id", "p_id", "score", *HTTP_FIELDS]
    for run in (plan.detect, plan.score_requests):
        wanted, found = (sorted(map(tuple, run(records, known, o).select(columns).collect()))
                         for o in (DetectOptions(), small))
        assert found == wanted and max(wanted.count(row) for row in set(wanted)) == 7


def test_records_that_share_an_id_keep_their_own_alarms(spark):
    """Two different records with one id: the same rows for any bound of a broadcast."""
    records = requests(spark, 5).withColumn("uri", F.when(F.col("record_id") < "2", "/a?v=12").otherwise("/a?v=3456"))
    records = records.withColumn("record_id", F.lit("x"))
    known = models(spark, extract_features(requests(spark, 1)))
    columns = ["record_id", "p_id", "score", *HTTP_FIELDS]
    for run in (plan.detect, plan.score_requests):
        wanted, found = (sorted(map(tuple, run(records, known, DetectOptions(broadcast_bytes=b)).select(columns).collect()))
                         for b in (64 << 20, 0))
        of = {uri: {row[1:3] for row in wanted if row[columns.index("uri")] == uri} for uri in ("/a?v=12", "/a?v=3456")}
        assert found == wanted and len(wanted) == 2 * len(of["/a?v=12"]) + 3 * len(of["/a?v=3456"])
        assert of["/a?v=12"] != of["/a?v=3456"]


@pytest.mark.parametrize("k", [2, 3, 8, 9])
def test_runs_score_like_their_symbols(spark, k):
    """Runs of every length up to beyond the largest power, in log space symbol by symbol."""
    rng = np.random.default_rng(k)
    trans = rng.random((k, k)) + 0.05
    model = (np.full(k, 1 / k), trans / trans.sum(axis=1, keepdims=True), rng.uniform(60, 80, k), rng.uniform(1, 30, k))
    texts = ["A" * n + "N" * m + tail for n, m in ((1, 1), (2, 3), (31, 32), (63, 64), (65, 127), (128, 200), (1000, 1))
             for tail in ("", "-", "\x00A", "😀NN\nA", "CCC")] + ["\x00", "-", "\n\n", "NNNN" * 40]

    def forward(x):
        start, trans, means, variances = model
        emit = [-0.5 * (np.log(2 * np.pi * variances) + (ord(c) - means) ** 2 / variances) for c in x]
        alpha = np.log(start) + emit[0]
        for e in emit[1:]:
            alpha = np.logaddexp.reduce(alpha[:, None] + np.log(trans), axis=0) + e
        return np.logaddexp.reduce(alpha)

    assert native_scores(spark, [(model, t) for t in texts]) == pytest.approx([forward(t) for t in texts], rel=1e-12)


def test_semi_and_anti_joins_divide_the_observations(spark):
    features = extract_features(requests(spark, 200))
    known = models(spark, features.where("p_type = 'uri'"))
    for limit in (1 << 20, 0):
        inside, outside = (f(features, known, limit=limit) for f in (modelled, unmodelled))
        assert inside.count() + outside.count() == features.count() and inside.count() == 200
    grouped = unmodelled(features.groupBy("p_id", "symbols").count(), known)
    assert grouped.count() == features.select("p_id", "symbols").distinct().count() - 1


def test_sent_bytes_counts_nested_columns(spark):
    df = cut(spark.sql("select 'ab' as a, array(1D, 2D) as b, array(array(1D), array(2D)) as c, array(struct(1D as x)) as d, null as e"))
    assert 100 < sent_bytes(df) < 400


def test_models_of_equal_numbers_score_a_sequence_once(spark, monkeypatch):
    """Five hosts are five parameters a name; their models hold the same numbers but two profiles."""
    records = requests(spark, 60).withColumn("host", F.concat(F.lit("h"), (F.col("record_id") % 5).cast("int").cast("string")))
    records = records.withColumn("uri", F.concat(F.lit("/a?v="), F.repeat(F.lit("7"), (F.col("record_id") % 3).cast("int") + 1)))
    observed = plan.observe(records, content=False)
    known = models(spark, observed.where("p_name = 'v'"))
    odd = F.col("p_id") < known.agg(F.max("p_id")).first()[0]
    known = cut(known.withColumns({"profile": F.when(odd, 0.0).otherwise(-9.0),
                                   "means": F.when(odd, F.array(F.lit(78.0))).otherwise(F.array(F.lit(65.0)))}))
    given, score = [], plan.score
    monkeypatch.setattr(plan, "score", lambda joined: given.append(joined.count()) or score(joined))
    columns = ["record_id", "p_id", "symbols", "score", "profile", "p_name"]
    for limit in (1 << 20, 0):
        got = sorted(map(tuple, plan.score_observed(observed, known, limit).select(columns).collect()))
        assert given.pop() == 2 * 3 and not given  # two sets of numbers, three sequences
        direct = score(plan.join_models(observed, plan.model_side(known)))
        assert got == sorted(map(tuple, direct.select(columns).collect())) and len(got) == 60
        assert plan.score_distinct(observed, known, limit).count() == 15 and given.pop() == 6
    assert "_content" not in observed.columns and "_content" in plan.observe(records).columns


def test_sequences_are_counted_before_scores_go_back(spark, sf, monkeypatch):
    from wirewarden.catalog import queries
    seen, back = [], queries.score_observed
    monkeypatch.setattr(queries, "score_observed", lambda o, m: seen.append(o) or back(o, m))
    for name in ("score_3sigma", "profile_min", "worst_sequence"):
        assert queries.QUERIES[name](spark, sf).count() > 0
        rows = seen.pop()
        assert rows.count() == rows.select("p_id", "symbols").distinct().count() < rows.agg(F.sum("weight")).first()[0]


def test_sequences_are_counted_while_they_are_extracted(spark, sf, monkeypatch):
    """No observation is written, and extraction makes keys and names outside lambdas."""
    from wirewarden.catalog import queries
    records, plans, kept = queries._requests(spark, sf), [], plan.stored
    wanted = plan.observe(records, content=False).groupBy("p_id", "p_name", "symbols").count()
    monkeypatch.setattr(plan, "stored", lambda df, name: plans.append(df) or kept(df, name))
    counted = plan.observe_sequences(records)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, wanted.collect()))
    (written,) = plans
    assert set(written.columns) == {"p_id", "p_name", "symbols", "weight"}
    text = written._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Aggregate") < text.index("Generate") and "named_struct(key" not in text
