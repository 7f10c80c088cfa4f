"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wirewarden.catalog import derived  # noqa: E402
from wirewarden.catalog.queries import QUERIES  # noqa: E402
from wirewarden.operators.features import extract_features  # noqa: E402
from wirewarden.operators.requests import http_requests_only  # noqa: E402
from wirewarden.plans.detect import score_requests  # noqa: E402
from wirewarden.plans.train import observed_sequences, train_sequences  # noqa: E402
from wirewarden.session import cut, local_session  # noqa: E402

# whole result computed and dropped, no rows pulled to the driver
HEADLINE = [
    "parse_flows", "normalize_request", "extract_features", "group_sequences", "train_groups",
    "hmm_score", "detect_batch", "count_day_device", "train_and_detect",
]


def drain(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=cpus, memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    drain(QUERIES["extract_features"](spark, sf_dir).limit(100))
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        drain(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.time() - start, 3)
    # the three job kernels on a stored archive, as rows per second
    path = cut(derived.http_records(spark, sf_dir))
    n = path.count()
    features = extract_features(http_requests_only(path))
    n_features = features.count()
    start = time.time()
    drain(features)
    extract = time.time() - start
    start = time.time()
    models = cut(train_sequences(observed_sequences(path)))
    train = time.time() - start
    start = time.time()
    drain(score_requests(path, models))
    score = time.time() - start
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "records": n, "features": n_features, "models": models.count(),
        "features_per_sec": round(n_features / extract), "train_sec": round(train, 3),
        "scored_records_per_sec": round(n / score),
    }))


if __name__ == "__main__":
    main()
