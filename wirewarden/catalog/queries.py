"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

import numpy as np
from pyspark.sql import DataFrame, Observation, functions as F

from ..functions import (
    encode_symbols,
    epoch_ms_day,
    is_cjk,
    kv_name,
    kv_value,
    param_key,
    symbol_states,
    text_id,
    url_quote,
    url_unquote,
)
from ..operators import features as feat
from ..operators import flows, hmm
from ..operators.grouping import group_sequences, parameter_stats, sequence_stats, train_counts, with_min_support
from ..operators.joins import join_models, latest_models, modelled, unmodelled
from ..operators.requests import (
    http_requests_only,
    normalize,
    parse_json_records,
    sparse_document,
)
from ..operators.scoring import score, with_score_parameters
from ..operators.thresholds import alarm_columns, anomalies, outside_three_sigma, score_profiles, worst_sequences
from ..plans.detect import detect, observe, observe_sequences, score_observed
from ..plans import devices
from ..plans.devices import count_day_device, split_lines, with_device_fields
from ..plans.options import TrainOptions
from ..plans.train import observed_sequences, train_groups, train_sequences
from ..schemas import HTTP_FIELDS, MODELS
from ..session import cut, shared_path
from ..operators.training import SameModel, expectation_sums, fit_large, repaired, stepped
from ..sources.queue import queue_messages, read_text_stream
from ..sources.sinks import DocumentSink, read_documents
from ..sources import tables
from ..sources.tables import read_archive, read_models, write_archive, write_models
from ..streaming import jobs
from . import derived

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _requests(spark, sf):
    return http_requests_only(derived.http_records(spark, sf))


def _features(spark, sf):
    return feat.extract_features(_requests(spark, sf))


def _states_text(symbols="symbols"):
    return F.array_join(symbol_states(F.col(symbols)).cast("array<string>"), ",").alias("states")


def _shown(features: DataFrame, *more) -> DataFrame:
    return features.select("record_id", "p_id", "p_type", "p_name", _states_text(), *more)


# sources and serialisation ---------------------------------------------------

@query
def scan_json_archive(spark, sf):
    path = shared_path(spark, "archive")
    write_archive(derived.http_records(spark, sf), path, "json")
    return read_archive(spark, path, "json").select(*HTTP_FIELDS)


@query
def scan_models(spark, sf):
    path = shared_path(spark, "models")
    write_models(train_sequences(observed_sequences(derived.http_records(spark, sf))), path, "1")
    return read_models(spark, path).select("p_id", "p_type", "p_name", "n_seq", "n_components", "model_version")


@query
def to_json_record(spark, sf):
    messages = queue_messages(derived.http_records(spark, sf))
    return parse_json_records(messages).select(F.col("key").cast("string").alias("record_id"), *HTTP_FIELDS)


@query
def parse_json_record(spark, sf):
    text = F.to_json(F.struct(*HTTP_FIELDS))
    broken = F.when(F.col("event_id") % 7 == 0, F.substring(text, 1, 60)).otherwise(text)
    values = derived.http_records(spark, sf).select("record_id", broken.cast("binary").alias("value"))
    return parse_json_records(values).select(
        "record_id", "parsed", "flow_time", "uri", "cookie", "data", "content_length"
    )


# raw flows -------------------------------------------------------------------

@query
def http_classify(spark, sf):
    raw = derived.flow_raw(spark, sf)
    return raw.select("path", flows.classify(flows.flow_text(F.col("content"))).alias("kind"))


@query
def flow_tuple(spark, sf):
    return derived.flow_raw(spark, sf).select(
        "path", *[c.alias(n) for n, c in flows.flow_tuple(F.col("path")).items()]
    )


@query
def http_split_messages(spark, sf):
    messages = flows.split_messages(derived.flow_raw(spark, sf))
    return messages.select("path", "msg_no", "kind", F.md5("message").alias("message_md5"))


def _with_key(messages):
    return messages.withColumn("record_id", F.concat_ws("#", "path", "msg_no"))


@query
def http_parse_request(spark, sf):
    rows = _with_key(flows.parse_requests(flows.split_messages(derived.flow_raw(spark, sf))))
    return rows.select("record_id", "method", "uri", "host", "user_agent", "cookie", "referer",
                       "content_type", "content_encoding", "content_length", "data")


@query
def http_parse_response(spark, sf):
    rows = _with_key(flows.parse_responses(flows.split_messages(derived.flow_raw(spark, sf))))
    return rows.select("record_id", "status", "server", "content_type", "content_length", "date",
                       "content_encoding", "data")


@query
def fill_empty_fields(spark, sf):
    rows = parse_flows(spark, sf)
    empty = [F.when(F.col(c) == "", 1).otherwise(0) for c in HTTP_FIELDS if c != "flow_time"]
    return rows.select("record_id", "http_type", sum(empty[1:], empty[0]).alias("n_empty"), "status", "data")


QUERIES["fill_empty"] = QUERIES.pop("fill_empty_fields")


@query
def parse_flows(spark, sf):
    return flows.parse_flows(derived.flow_raw(spark, sf))


@query
def scan_flow_files(spark, sf):
    """The flows as files of a folder, read and parsed."""
    path = shared_path(spark, "flows")
    derived.flow_files(spark, sf, path)
    return flows.parse_flows(tables.read_flows(spark, path))


@query
def http_records_union(spark, sf):
    return parse_flows(spark, sf).groupBy("http_type", "method", "status").agg(
        F.count("*").alias("n"), F.countDistinct("src_ip").alias("n_src")
    )


# records ---------------------------------------------------------------------

@query
def filter_http_method(spark, sf):
    return _requests(spark, sf).select("record_id", "method", "uri")


@query
def normalize_request(spark, sf):
    return normalize(_requests(spark, sf)).select(
        "record_id", "uri_text", "host_text", "method_text", "path", "payload"
    )


@query
def sparse_document_fields(spark, sf):
    records = derived.http_records(spark, sf)
    docs = records.select("record_id", sparse_document(records.select(*HTTP_FIELDS)).alias("doc"))
    read = F.from_json("doc", "map<string,string>")
    back = docs.select("record_id", read.alias("m"))
    return back.select(
        "record_id", F.size("m").alias("n_fields"),
        *[F.try_element_at("m", F.lit(c)).alias(c) for c in ("data", "cookie", "status")],
        F.try_element_at("m", F.lit("flow_time")).cast("bigint").alias("flow_time"),
    )


QUERIES["sparse_document"] = QUERIES.pop("sparse_document_fields")


@query
def rejected_records(spark, sf):
    return feat.rejected_records(_requests(spark, sf)).select("record_id", "reason")


@query
def rejected_archive_lines(spark, sf):
    """An archive with cut lines and lines of one mistyped field: what is kept and what is rejected."""
    line = F.to_json(F.struct(*HTTP_FIELDS))
    broken = F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 60)).when(
        F.col("event_id") % 11 == 0, F.regexp_replace(line, '"flow_time":', '"flow_time":"x",  "was":')).otherwise(line)
    path = shared_path(spark, "archive")
    derived.http_records(spark, sf).select(broken.alias("value")).write.text(path)
    kept = read_archive(spark, path, "json").groupBy("method").agg(F.count("*").alias("n"))
    lost = tables.rejected_archive_lines(spark, path).groupBy(
        F.when(F.length("value") == 60, "cut").otherwise("mistyped").alias("method")).agg(F.count("*").alias("n"))
    return kept.withColumn("kept", F.lit(True)).unionByName(lost.withColumn("kept", F.lit(False)))


@query
def rejected_messages(spark, sf):
    """Device messages, those of some devices cut off: what can't be counted."""
    whole = derived.device_messages(spark, sf)
    cut_off = F.when(F.endswith("message", F.lit("3")), F.substring("message", 1, 8)).otherwise(F.col("message"))
    return devices.rejected_messages(whole.select(cut_off.alias("message"))).groupBy("message").agg(
        F.count("*").alias("n"))


def _renamed_flows(spark, sf):
    path = F.when(F.endswith("path", F.lit("3")), F.concat(F.lit("broken-"), "path")).otherwise(F.col("path"))
    return derived.flow_raw(spark, sf).select(path.alias("path"), "content")


@query
def rejected_flows(spark, sf):
    """Flows of which some have no readable name: rejected, and messages parsed from the others."""
    raw = _renamed_flows(spark, sf)
    parsed = flows.parse_flows(raw).groupBy("http_type").agg(F.count("*").alias("n"))
    return parsed.unionByName(flows.rejected_flows(raw).groupBy(F.col("reason").alias("http_type")).agg(
        F.count("*").alias("n")))


# scalar functions over whole texts ---------------------------------------------

def _documents(spark, sf):
    return derived.table(spark, sf, "documents")


@query
def url_quote_text(spark, sf):
    quoted = _documents(spark, sf).select("doc_id", url_quote(F.col("text")).alias("q"))
    return quoted.select("doc_id", F.md5("q").alias("quoted_md5"), F.length("q").alias("n"))


@query
def url_unquote_text(spark, sf):
    pages = derived.table(spark, sf, "pages")
    return pages.select(
        "page_id", F.md5(url_unquote(F.col("html"))).alias("html_md5"),
        url_unquote(url_quote(F.col("url"))).alias("url"),
    )


@query
def url_unquote2(spark, sf):
    pages = derived.table(spark, sf, "pages")
    return pages.select(
        "page_id", F.md5(url_unquote(url_unquote(F.col("html")))).alias("html_md5"),
        url_unquote(url_unquote(url_quote(url_quote(F.col("url"))))).alias("url"),
    )


QUERIES["url_quote"] = QUERIES.pop("url_quote_text")
QUERIES["url_unquote"] = QUERIES.pop("url_unquote_text")


@query
def url_path(spark, sf):
    return normalize(_requests(spark, sf)).select("record_id", "path")


@query
def url_payload(spark, sf):
    return normalize(_requests(spark, sf)).select("record_id", "payload")


@query
def md5_id(spark, sf):
    return _documents(spark, sf).select("doc_id", text_id(F.col("text")).alias("id"))


@query
def param_id(spark, sf):
    parts = F.col("host_text"), F.col("path"), F.col("method_text")
    kinds = {"named_id": "uri", "path_id": "uri_path", "http_type_id": "http_type",
             "content_length_id": "content_length", "pname_id": "uri_pname"}
    return normalize(_requests(spark, sf)).select(
        "record_id", *[text_id(param_key(k, *parts, name=F.lit("x"))).alias(n) for n, k in kinds.items()]
    )


@query
def encode_symbols_text(spark, sf):
    coded = _documents(spark, sf).select("doc_id", encode_symbols(F.col("text")).alias("symbols"))
    return coded.select("doc_id", F.md5(_states_text()).alias("states_md5"), F.length("symbols").alias("n_symbols"))


QUERIES["encode_symbols"] = QUERIES.pop("encode_symbols_text")


@query
def is_cjk_text(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", is_cjk(F.col("text")).alias("has_cjk"),
        is_cjk(F.concat("text", F.lit("中"))).alias("with_cjk"),
    )


QUERIES["is_cjk"] = QUERIES.pop("is_cjk_text")


@query
def split_kv(spark, sf):
    tokens = normalize(_requests(spark, sf)).select(
        "record_id", F.posexplode_outer(F.split("payload", "&")).alias("pos", "tok")
    )
    return tokens.where(F.contains("tok", F.lit("="))).select(
        "record_id", "pos", kv_name(F.col("tok")).alias("p_name"), kv_value(F.col("tok")).alias("p_value")
    )


@query
def epoch_ms_days(spark, sf):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return derived.table(spark, sf, "events").select("event_id", epoch_ms_day(millis).alias("day"))


QUERIES["epoch_ms_day"] = QUERIES.pop("epoch_ms_days")


@query
def device_fields(spark, sf):
    return with_device_fields(derived.device_messages(spark, sf))


@query
def split_text_lines(spark, sf):
    lines = split_lines(_documents(spark, sf), "text", "doc_id")
    return lines.groupBy("doc_id", F.md5("message").alias("line_md5")).agg(F.count("*").alias("n"))


QUERIES["split_lines"] = QUERIES.pop("split_text_lines")


@query
def sequence_statistics(spark, sf):
    return _shown(sequence_stats(_features(spark, sf)), "n_symbols", "n_distinct")


QUERIES["sequence_stats"] = QUERIES.pop("sequence_statistics")


@query
def concat_names(spark, sf):
    return feat.prepare(_requests(spark, sf)).select(
        "record_id",
        feat._joined_names(F.col("payload"), "&", True).alias("uri_names"),
        feat._joined_names(F.col("cookie_text"), "; ", False).alias("cookie_names"),
    )


# feature generators ----------------------------------------------------------

def _generator(kind, body=None):
    def run(spark, sf):
        requests = _requests(spark, sf)
        if body:
            requests = requests.where(feat.body_kind(F.col("content_type")) == body)
        return _shown(feat.generate(requests, kind))
    return run


for _kind in feat.GENERATORS:
    if _kind != "post":
        QUERIES[f"feat_{_kind}"] = _generator(_kind)
for _body in ("form", "json", "xml"):
    QUERIES[f"feat_post_{_body}"] = _generator("post", _body)


@query
def post_dispatch(spark, sf):
    ready = feat.prepare(_requests(spark, sf))
    return ready.select(
        "record_id", "body_kind", F.coalesce(F.size("body_pairs"), F.lit(0)).alias("n_pairs")
    ).withColumn("n_pairs", F.greatest("n_pairs", F.lit(0)))


@query
def extract_features(spark, sf):
    return _shown(_features(spark, sf))


@query
def dedupe_last_wins(spark, sf):
    """Survivor of every id next to the number of entries it replaced."""
    requests = _requests(spark, sf)
    written = feat.extract_features(requests, dedupe=False).groupBy("record_id", "p_id").agg(
        F.count("*").alias("n_written")
    )
    kept = feat.extract_features(requests)
    return kept.join(written, ["record_id", "p_id"]).select(
        "record_id", "p_id", "n_written", "p_type", _states_text()
    )


# joins and models ------------------------------------------------------------

def _named_models(features):
    """The hand-set model of its name for every parameter that has one, materialised."""
    spark = features.sparkSession
    hand = spark.createDataFrame(
        [(name, len(m[0]), *m) for name, m in derived.HAND_MODELS.items()],
        "p_name string, n_components int, startprob array<double>, transmat array<array<double>>, "
        "means array<double>, vars array<double>, profile double")
    named = features.select("p_id", "p_name").distinct().join(F.broadcast(hand), "p_name")
    return cut(named.withColumns({
        "p_type": F.lit("named"), "model_version": F.lit("1"), "trained_at": F.lit(None).cast("timestamp")}))


def _scored(spark, sf):
    observed = observe(_requests(spark, sf), content=False)
    return score_observed(observed, _named_models(observed))


@query
def join_feature_model(spark, sf):
    features = cut(_features(spark, sf))
    joined = join_models(features, _named_models(features))
    return joined.select("record_id", "p_id", "p_name", _states_text(), "n_components")


@query
def latest_model(spark, sf):
    """Model rows of several versions per parameter: one per label seen."""
    rows = _features(spark, sf).groupBy("p_id", "p_type").agg(F.count("*").alias("n_seq"))
    versions = rows.select(
        "p_id", F.col("p_type").alias("model_version"), "n_seq",
        F.timestamp_seconds(F.col("n_seq") * 1000 + F.length("p_type")).alias("trained_at"),
    )
    return latest_models(versions).select("p_id", "model_version", "n_seq")


@query
def modelled_features(spark, sf):
    features = cut(_features(spark, sf))
    return modelled(features, _named_models(features)).select("record_id", "p_id", "p_type", "p_name")


@query
def unmodelled_features(spark, sf):
    features = cut(_features(spark, sf))  # extracted once for the models and for the join
    return unmodelled(features, _named_models(features)).select("record_id", "p_id", "p_type", "p_name")


# aggregates --------------------------------------------------------------------

def _sequences(spark, sf):
    return group_sequences(_features(spark, sf))


@query
def group_sequence_counts(spark, sf):
    return _sequences(spark, sf).select("p_id", "p_type", "p_name", _states_text(), "weight", "first_time")


QUERIES["group_sequences"] = QUERIES.pop("group_sequence_counts")


@query
def group_meta(spark, sf):
    return parameter_stats(_sequences(spark, sf)).select("p_id", "p_type", "p_name")


@query
def min_support(spark, sf):
    return with_min_support(parameter_stats(_sequences(spark, sf))).select("p_id", "n_seq")


@query
def hidden_state_count(spark, sf):
    return parameter_stats(_sequences(spark, sf)).select("p_id", "n_components")


@query
def train_group_table(spark, sf):
    return train_groups(_sequences(spark, sf)).select(
        "p_id", "p_type", "p_name", "n_seq", "n_components", "n_symbols"
    )


QUERIES["train_groups"] = QUERIES.pop("train_group_table")


@query
def train_count_row(spark, sf):
    return train_counts(_sequences(spark, sf))


QUERIES["train_counts"] = QUERIES.pop("train_count_row")


@query
def train_counts_observed(spark, sf):
    """The same numbers as metrics of the training pass."""
    counts = Observation("training")
    models = train_sequences(observed_sequences(derived.http_records(spark, sf)), counts=counts)
    # one row, next to the number of models that the pass led to
    return models.agg(F.count("*").alias("n_models")).select(
        *[F.lit(counts.get[n]).cast("bigint").alias(n) for n in ("n_features", "n_parameters", "n_effective")], "n_models")


def _scored_sequences(spark, sf):
    """Weighted distinct sequences with their scores; they are counted first, so that
    the scores go back to sequences instead of observations."""
    observed = observe_sequences(_requests(spark, sf))
    sequences = cut(observed.groupBy("p_id", "symbols").agg(F.sum("weight").alias("weight")))
    scored = score_observed(sequences, _named_models(observed))
    return scored.select("p_id", "symbols", "weight", "score", F.lit(0.0).alias("center"))


@query
def profile_min(spark, sf):
    return score_profiles(_scored_sequences(spark, sf)).select("p_id", F.round("profile", 6).alias("profile"))


@query
def score_3sigma(spark, sf):
    profiles = score_profiles(_scored_sequences(spark, sf))
    return profiles.select(
        "p_id", F.round("score_mean", 6).alias("score_mean"), F.round("score_std", 6).alias("score_std"),
        outside_three_sigma().alias("outside"),
    )


@query
def worst_sequence(spark, sf):
    scored = _scored_sequences(spark, sf)
    # equal scores up to rounding tie, and the smaller sequence is named
    tied = worst_sequences(scored.select("p_id", F.round("score", 9).alias("score"), _states_text().alias("symbols")))
    return tied.select("p_id", F.col("symbols").alias("states"), F.round("score", 6).alias("score"))


@query
def count_device_days(spark, sf):
    return count_day_device(derived.device_messages(spark, sf))


QUERIES["count_day_device"] = QUERIES.pop("count_device_days")


# models --------------------------------------------------------------------------

@query
def hmm_score(spark, sf):
    return _scored(spark, sf).select("record_id", "p_id", _states_text(), F.round("score", 6).alias("score"))


@query
def detect_anomalies(spark, sf):
    found = anomalies(_scored(spark, sf), emit_all=True)
    return found.select("record_id", "p_id", F.round("score", 6).alias("score"), "is_anomaly")


@query
def alarm_projection(spark, sf):
    rows = alarm_columns(_scored(spark, sf), ["record_id"])
    return rows.withColumn("score", F.round("score", 6))


@query
def detect_batch(spark, sf):
    requests = _requests(spark, sf)
    observed = observe(requests)
    alarms = detect(requests, _named_models(observed), observed=observed)
    return alarms.select("record_id", "p_id", "p_name", F.round("score", 6).alias("score"), "p_profile",
                         "uri", "src_ip", "flow_time", "alarm_type")


@query
def transmat_repair(spark, sf):
    """Observed digit / non-digit transitions of every parameter, repaired."""
    states = F.transform(F.split("symbols", ""), lambda ch: ch == "N")
    seq = _sequences(spark, sf).where(F.length("symbols") > 1).select("p_id", "weight", states.alias("s"))
    pairs = seq.select(
        "p_id", "weight",
        F.explode_outer(F.zip_with(
            F.slice("s", F.lit(1), F.size("s") - 1), F.slice("s", F.lit(2), F.size("s")),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        )).alias("p"),
    )
    def cell(a, b):
        hit = (F.col("p.a") == F.lit(a)) & (F.col("p.b") == F.lit(b))
        return F.sum(F.when(hit, F.col("weight")).otherwise(0)).cast("double")
    counts = pairs.groupBy("p_id").agg(
        cell(True, True).alias("nn"), cell(True, False).alias("nx"),
        cell(False, True).alias("xn"), cell(False, False).alias("xx"),
    )
    def row(a, b):
        total = F.greatest(F.col(a) + F.col(b), F.lit(1.0))
        return F.array(F.col(a) / total, F.col(b) / total)
    fixed = counts.select("p_id", repaired(F.array(row("nn", "nx"), row("xn", "xx"))).alias("t"))
    return fixed.select(
        "p_id", *[F.round(F.col("t")[i][j], 9).alias(f"t{i}{j}") for i in (0, 1) for j in (0, 1)]
    )


def _trained(spark, sf, **options):
    return train_sequences(observed_sequences(derived.http_records(spark, sf)), TrainOptions(**options))


_MODEL_COLUMNS = ["p_id", "p_type", "p_name", "n_seq", "n_components", "n_iter", "converged"]


def _model_rows(models):
    """Models with their arrays as text and their numbers rounded."""
    flat = F.flatten("transmat")
    arrays = {"startprob": F.col("startprob"), "transmat": flat, "means": F.col("means"), "vars": F.col("vars")}
    texts = [
        F.array_join(F.transform(c, lambda v: F.round(v, 6).cast("string")), ",").alias(n)
        for n, c in arrays.items()
    ]
    numbers = [F.round(c, 6).alias(c) for c in ("profile", "score_mean", "score_std")]
    return models.select(*_MODEL_COLUMNS, *texts, *numbers)


@query
def hmm_train(spark, sf):
    return _model_rows(_trained(spark, sf))


@query
def hmm_train_robust(spark, sf):
    return _model_rows(_trained(spark, sf, robust=True))


@query
def hmm_train_single_state(spark, sf):
    """Parameters with one hidden state, whose fit has a closed form."""
    return _trained(spark, sf).where("n_components = 1").select(
        "p_id", "n_seq", F.round(F.col("means")[0], 6).alias("mean"),
        F.round(F.col("vars")[0], 9).alias("variance"), F.round("profile", 5).alias("profile"),
    )


@query
def train_models(spark, sf):
    """Every model with the sums that make it a distribution."""
    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    models = _trained(spark, sf)
    return models.select(
        "p_id", "p_type", "p_name", "n_seq", "n_components",
        F.round(total(F.col("startprob")), 6).alias("start_sum"),
        F.round(total(F.flatten("transmat")), 6).alias("transition_sum"),
        (F.array_min("vars") > 0).alias("has_variance"),
        (F.col("profile") <= F.col("score_mean")).alias("profile_below_mean"),
    )


@query
def train_and_detect(spark, sf):
    """Train on the clean requests, then raise alarms on all of them."""
    records = derived.http_records(spark, sf)
    clean = records.where(F.col("event_id") % derived.ATTACK_STEP != 0)
    models = cut(train_sequences(observed_sequences(clean)))
    return detect(records, models).select(
        "record_id", "alarm_type", "p_id", "p_name", "p_type", "p_profile", "score", "uri", "alarm_id"
    )


_EM_SUMS = ["loglik", "start0", "start1", "t00", "t01", "t10", "t11", "mass0", "mass1", "first0", "first1",
            "second0", "second1"]


def _em_sums(spark, sf):
    """Sums of one E step of the two-state model over all sequences of every parameter, by the training's code."""
    rows = cut(_sequences(spark, sf)).select("p_id", "symbols", "weight")
    model = tuple(np.array(part) for part in derived.EM_MODEL)
    sums = expectation_sums(rows, SameModel(model))
    value = F.col("whole") + F.col("part") / hmm.FRACTION
    wide = sums.groupBy("p_id").agg(*[
        F.max(F.when(F.col("pos") == i, value)).alias(name) for i, name in enumerate(_EM_SUMS)])
    return wide.join(rows.groupBy("p_id").agg(F.sum("weight").alias("n_seq")), "p_id")


def _digits(value):
    """Six decimals of a number, fewer of a large one; no negative zero."""
    return F.when(F.abs(value) < 1e5, F.round(value, 6)).otherwise(F.round(value / 1e10, 8)) + F.lit(0.0)


@query
def em_sums(spark, sf):
    # exp of a difference of numbers near 1e8 has no more than three digits
    coarse = F.abs(F.col("loglik") / F.col("n_seq")) > 1e5
    return _em_sums(spark, sf).select("p_id", "n_seq", *[
        F.when(coarse & (F.abs(F.col(c) / F.col("n_seq")) < 1e5), F.round(F.col(c) / F.col("n_seq"), 3) + F.lit(0.0))
        .otherwise(_digits(F.col(c) / F.col("n_seq"))).alias(c) for c in _EM_SUMS])


@query
def em_step(spark, sf):
    """The model after one round, by the training's M step; null for a state with next to no weight."""
    start, trans, means, variances = derived.EM_MODEL

    def array(values):
        return F.array(*[F.lit(v) for v in values])

    model = stepped(array(start), array(trans[0] + trans[1]), array(means), array(variances), F.array(*_EM_SUMS))
    stated = {f"startprob{j}": (F.lit(1.0), F.col("m.startprob")[j]) for j in (0, 1)}
    for i in (0, 1):
        stated |= {f"transmat{2 * i + j}": (F.col(f"t{i}0") + F.col(f"t{i}1"), F.col("m.transmat")[2 * i + j]) for j in (0, 1)}
        stated |= {f"{part}{i}": (F.col(f"mass{i}"), F.col(f"m.{part}")[i]) for part in ("means", "vars")}
    return _em_sums(spark, sf).withColumn("m", model).select(
        "p_id", *[F.when(weight > 0.01, _digits(value)).alias(name) for name, (weight, value) in stated.items()])


@query
def em_rounds(spark, sf):
    """Three rounds of the distributed training: every parameter from the same two-state model to one of its own."""
    rows = cut(_sequences(spark, sf))
    stats = cut(parameter_stats(rows).withColumn("n_components", F.lit(2)))
    start, trans, means, variances = (F.lit(part) for part in derived.EM_WIDE_MODEL)
    starts = cut(stats.select("p_id", "n_components", start.alias("startprob"), trans.alias("transmat"),
                              means.alias("means"), variances.alias("vars")))
    fitted = fit_large(rows, stats, max_iter=derived.EM_ROUNDS, tolerance=float("-inf"), starts=starts)
    parts = {"startprob": F.col("startprob"), "transmat": F.flatten("transmat"), "means": F.col("means"), "vars": F.col("vars")}
    return fitted.join(stats.select("p_id", "n_seq"), "p_id").select(
        "p_id", "n_iter", _digits(F.col("loglik") / F.col("n_seq")).alias("loglik"),
        *[_digits(c[i]).alias(f"{name}{i}") for name, c in parts.items() for i in range(4 if name == "transmat" else 2)])


# streams over files, run until all input is read ------------------------------------

_ALL = {"availableNow": True}


def _messages(spark, sf, values, rows_per_file=0):
    """A folder of gzipped text messages below the shared folder, as a stream."""
    path = shared_path(spark, "messages")
    values.write.option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).text(path)
    return read_text_stream(spark, path, files_per_trigger=4)


def _record_messages(spark, sf, rows_per_file=0):
    values = queue_messages(derived.http_records(spark, sf)).select(F.col("value").cast("string"))
    return _messages(spark, sf, values, rows_per_file)


@query
def stream_archive(spark, sf):
    path = shared_path(spark, "stream-archive")
    jobs.archive_stream(_record_messages(spark, sf), path, shared_path(spark, "progress"), trigger=_ALL).awaitTermination()
    return read_archive(spark, path).select(*HTTP_FIELDS)


@query
def stream_archive_rejects(spark, sf):
    """Messages of which some are cut off, read once: what is archived and what is rejected."""
    line = F.to_json(F.struct(*HTTP_FIELDS))
    broken = F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 60)).otherwise(line)
    path, bad = shared_path(spark, "stream-archive"), shared_path(spark, "stream-rejects")
    values = _messages(spark, sf, derived.http_records(spark, sf).select(broken.alias("value")))
    jobs.archive_and_rejects_stream(values, path, bad, shared_path(spark, "progress"), trigger=_ALL).awaitTermination()
    kept = read_archive(spark, path).groupBy("method").agg(F.count("*").alias("n"), F.sum("flow_time").alias("time_sum"))
    lost = spark.read.text(bad).groupBy(F.length("value").cast("string").alias("method")).agg(
        F.count("*").alias("n"), F.lit(None).cast("bigint").alias("time_sum"))
    return kept.withColumn("kept", F.lit(True)).unionByName(lost.withColumn("kept", F.lit(False)))


@query
def stream_detect(spark, sf):
    """Alarms of the live job with the hand-set models, as documents."""
    models, root = _named_models(_features(spark, sf)), shared_path(spark, "stream-models")
    have = set(models.columns)
    kinds = dict(f.split() for f in MODELS.split(", "))
    write_models(models.select(*[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]),
                 root, "1")
    sink = DocumentSink("alarms", shared_path(spark, "documents"))
    values = _record_messages(spark, sf, rows_per_file=100_000)  # what a batch stores for a while grows with its files
    jobs.detect_stream(values, root, sink, shared_path(spark, "progress"), trigger=_ALL).awaitTermination()
    found = read_documents(spark, sink, "flow_time bigint, src_port string, uri string, p_id string, p_name string, "
                                        "score double, p_profile double, alarm_type string")
    return found.select("flow_time", "src_port", "uri", "p_id", "p_name", F.round("score", 6).alias("score"),
                        "p_profile", "alarm_type")


@query
def stream_documents(spark, sf):
    """The records themselves as documents, without their empty fields."""
    sink = DocumentSink("records", shared_path(spark, "documents"), id_field="record_id")
    jobs.index_stream(_record_messages(spark, sf), sink, shared_path(spark, "progress"), trigger=_ALL).awaitTermination()
    return read_documents(spark, sink, "flow_time bigint, method string, uri string, cookie string, data string").drop("_id")


@query
def stream_document_source(spark, sf):
    """The same documents through the data source, whose batches count once they are published."""
    sink = DocumentSink("records", shared_path(spark, "documents"), format="documents", id_field="record_id")
    jobs.index_writer_stream(_record_messages(spark, sf), sink, shared_path(spark, "progress"), trigger=_ALL).awaitTermination()
    return read_documents(spark, sink, "flow_time bigint, method string, uri string, cookie string, data string").drop("_id")


@query
def stream_flow_files(spark, sf):
    """Flow files of a folder, archived as they come."""
    path, archive = shared_path(spark, "flows"), shared_path(spark, "stream-archive")
    derived.flow_files(spark, sf, path)
    values = tables.read_flow_stream(spark, path)
    jobs.flow_stream(values, archive, shared_path(spark, "progress"), trigger=_ALL).awaitTermination()
    return read_archive(spark, archive).select(*HTTP_FIELDS)


@query
def stream_counts(spark, sf):
    """Messages per day and device, added up over the micro-batches' text folders."""
    prefix = shared_path(spark, "counts") + "/part"
    lines = derived.device_messages(spark, sf).select(F.to_json(F.struct("message")).alias("value"))
    jobs.count_stream(_messages(spark, sf, lines), prefix, shared_path(spark, "progress"), trigger=_ALL).awaitTermination()
    read = spark.read.text(f"{prefix}-*").select(
        F.regexp_extract("value", r"^\('(.*)', (\d+)\)$", 1).alias("day_device"),
        F.regexp_extract("value", r"^\('(.*)', (\d+)\)$", 2).cast("bigint").alias("n"))
    return read.groupBy("day_device").agg(F.sum("n").alias("n"))


@query
def stream_late_counts(spark, sf):
    """A queue that is read, goes on and is read again: counts, and messages that come days too late.

    Messages of odd seconds arrive after all others; both runs are one job with one progress.
    """
    path, inbox, progress = (shared_path(spark, n) for n in ("late-counts", "messages", "progress"))
    second = F.floor(devices.message_millis(F.col("message")) / 1000)
    messages = derived.device_messages(spark, sf).withColumn("odd", F.pmod(second, F.lit(2)))
    for odd in (0, 1):
        part = messages.where(F.col("odd") == odd).select(F.to_json(F.struct("message")).alias("value"))
        part.write.mode("append").text(inbox)
        values = read_text_stream(spark, inbox, files_per_trigger=1 << 30)  # what is there is one batch
        jobs.count_and_late_stream(values, path, progress, trigger=_ALL).awaitTermination()
    late = with_device_fields(jobs.device_lines(jobs.read_late(spark, path)))
    late = late.groupBy("day", "device").agg(F.count("*").alias("n"))
    return jobs.read_counts(spark, path).withColumn("late", F.lit(False)).unionByName(
        late.withColumn("late", F.lit(True)))
