"""Fixed schemas; nothing in the package infers one."""

from pyspark.sql import types as T

# The flat fields of one HTTP record.
HTTP_FIELDS = [
    "referer", "http_type", "host", "cookie", "flow_time", "src_port", "uri", "src_ip",
    "dst_port", "dst_ip", "method", "user_agent", "content_type", "content_length",
    "content_encoding", "status", "server", "date", "data",
]

HTTP_RECORD = T.StructType([
    T.StructField(name, T.LongType() if name == "flow_time" else T.StringType())
    for name in HTTP_FIELDS
])

MODELS = (
    "p_id string, p_type string, p_name string, n_seq bigint, n_components int, "
    "startprob array<double>, transmat array<array<double>>, means array<double>, "
    "vars array<double>, profile double, score_mean double, score_std double, "
    "n_iter int, converged boolean, model_version string, trained_at timestamp"
)

ALARM_TYPE = "HmmParameterAnomaly"
HTTP_METHODS = ("GET", "POST")
