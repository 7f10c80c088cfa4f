"""Feature extraction: a full record with known ids, and edge cases."""

import json
import re
from urllib.parse import quote

from pyspark.sql import functions as F

from wirewarden.catalog import derived
from wirewarden.functions import symbol_states
from wirewarden.operators.features import extract_features, rejected_records
from wirewarden.operators.requests import fill_empty, parse_json_records, sparse_document, with_record_id
from wirewarden.plans import detect

COOKIE = (
    "JSESSIONID=a449d6d0-a91d-4db4-a619-ed55239675e9; socm4ia=33SdLeElYV-1ES4bZEzfJ2msWUzGyf8G%7Cguoweibo01."
    "3QGvYoBnZm98bE%2B6w%2B6e1RMN%2BY6x1H4YjY%2FQ5lfKKZU; connectId=s%3A33SdLeElYV-1ES4bZEzfJ2msWUzGyf8G."
    "8AqrleZu1lQY%2BvV2sakGkiUNdtcyB6WNYf1HfK%2FaPpA; socm4ts=0p4JtcIKKScCOzTN1ZJ_0kCoUVelMBsu%7Cguoweibo01."
    "1zRT7PIXe9CrS2Pn5kBTCQsKpwPydoKf0KaieeHD1I8; tsConnectId=s%3A0p4JtcIKKScCOzTN1ZJ_0kCoUVelMBsu."
    "7Z7vNkjVarRmFz0czSHUxEoMNzXnE69iYXxJWnKSkds"
)
XML = "<root><header><type>fetch</type></header><content><program>test</program></content></root>"
# p_type, p_name, p_id, length, distinct symbols, first symbols.
GOLDEN = [
    ("uri", "a", "b0dde0488517706aef9b2af54bb5f234", 2, 1, [78, 78]),
    ("uri", "b123", "3f088502160ba9ccba7a3d9eb2be1eda", 2, 1, [78, 78]),
    ("uri_pname", "", "63e2473b943d955baad9a5247ebaec76", 5, 2, [65, 65, 78, 78, 78]),
    ("uri_path", "", "8a8bdf00a7f9dd2c025d018d504d7656", 25, 2, [47, 65, 65, 65, 65, 65]),
    ("http_type", "", "d73a27333510a6d5e5b66051838b0f13", 7, 1, [65, 65, 65, 65, 65, 65]),
    ("content_length", "", "3803e7a39fa9094411b6865c31491091", 2, 1, [78, 78]),
    ("cookie", "JSESSIONID", "404857b7ec58d80b0212aa3ef42121c5", 36, 3, [65, 78, 78, 78, 65, 78]),
    ("cookie", "socm4ia", "462d9552e8ad5fcc57127905fe559d11", 97, 5, [78, 78, 65, 65, 65, 65]),
    ("cookie", "connectId", "9e734b58cae658988ff3bbf0d94e5b4d", 84, 5, [65, 37, 78, 65, 78, 78]),
    ("cookie", "socm4ts", "2754fc66b6a69d7b9819b232582a88bf", 89, 5, [78, 65, 78, 65, 65, 65]),
    ("cookie", "tsConnectId", "5a6df56a7d56444e4c798720fc347c8f", 80, 5, [65, 37, 78, 65, 78, 65]),
    ("cookie_pname", "", "9083e560dc9890d01436dd27b512ae91", 44, 2, [65, 65, 65, 65, 65, 65]),
    ("post", "root/header/type", "1bf596434a64363a4a2565b54a8304fb", 5, 1, [65, 65, 65, 65, 65]),
    ("post", "root/content/program", "70c7b2e018e9f4883d0fb978e0044d8c", 4, 1, [65, 65, 65, 65]),
    ("post_pname", "", "281a75277ca72c9d72c901f8ea284a8d", 36, 2, [65, 65, 65, 65, 47, 65]),
]


def extracted(spark, **fields):
    base = {"method": "GET", "host": "h", "uri": "/p", "flow_time": 1}
    return all_extracted(spark, [{**base, **fields}])


def frame(spark, rows):
    values = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return with_record_id(fill_empty(parse_json_records(values).drop("value", "parsed")))


def all_extracted(spark, rows):
    features = extract_features(frame(spark, rows)).withColumn("p_state", symbol_states(F.col("symbols")))
    return features.orderBy("record_id", "ord").collect()


def named(rows, p_type):
    return {r.p_name: r.p_state for r in rows if r.p_type == p_type}


def test_golden_record(spark):
    rows = extracted(
        spark, method="POST", host="10.10.10.1:8888", uri="/portal/logins/checklogin?a=23&b123=89", http_type="Request",
        content_length="43", content_type="text/xml", cookie=quote(COOKIE, safe=""), data=quote(XML),
    )
    got = [(r.p_type, r.p_name, r.p_id, len(r.p_state), len(set(r.p_state)), r.p_state[:6]) for r in rows]
    assert got == GOLDEN


def test_uri_tokens(spark):
    rows = extracted(spark, uri="/p?a=b=c&flag&e=&d=1&d=22")
    assert named(rows, "uri") == {"a": [65, 65], "e": [0], "d": [78, 78]}
    assert named(rows, "uri_pname") == {"": [65] * 8}


def test_params_query_and_fragment_run_together(spark):
    assert named(extracted(spark, uri="/p;x=1?q=2#f"), "uri") == {"x": [78, 65, 78, 65]}


def test_cookie_replaces_uri_and_field_collides_with_parameter(spark):
    rows = extracted(spark, uri="/p?n=1&http_type=zz", cookie="n%3Dabc", http_type="Request")
    assert named(rows, "uri") == {} and named(rows, "cookie") == {"n": [65] * 3}
    assert named(rows, "http_type") == {"": [65] * 7}


def test_blank_cookie_tokens(spark):
    rows = extracted(spark, cookie=quote("; ; x"))
    assert named(rows, "cookie") == {} and named(rows, "cookie_pname") == {"": [65]}


def test_empty_path_and_blank_fields_yield_nothing(spark):
    assert extracted(spark, uri="", host="", http_type=" ", cookie="\t", data=" ") == []


def test_x6_content_length_zero_is_no_observation(spark):
    for value, expected in (("", {}), ("0", {}), (0, {}), ("43", {"": [78, 78]}), (43, {"": [78, 78]})):
        assert named(extracted(spark, content_length=value), "content_length") == expected


def post(spark, content_type, body):
    return extracted(spark, method="POST", content_type=content_type, data=quote(body))


def test_x15_unknown_content_type_has_no_post_rows(spark):
    rows = post(spark, "multipart/form-data", "a=1")
    assert not [r for r in rows if r.p_type.startswith("post")]


def test_x16_malformed_bodies_are_rejected(spark):
    bodies = [("application/json", '{"a":'), ("application/json", "[1]"), ("text/xml", "<a>"), ("application/json", "{'a':1}")]
    base = {"method": "POST", "host": "h", "uri": "/p", "flow_time": 1}
    rows = [{**base, "content_type": t, "data": quote(b)} for t, b in bodies]
    assert not [r for r in all_extracted(spark, rows) if r.p_type.startswith("post")]
    reasons = sorted(r.reason for r in rejected_records(frame(spark, rows)).collect())
    assert reasons == ["malformed json"] * 3 + ["malformed xml"]


def test_x17_json_values_are_json_text(spark):
    rows = post(spark, "application/json", '{"o":{"a":1},"t":true,"n":null,"f":1.50,"d":1,"d":22}')
    assert named(rows, "post") == {"o": [123, 34, 65, 34, 58, 78, 125], "t": [65] * 4, "n": [0], "f": [78, 46, 78], "d": [78, 78]}
    assert named(rows, "post_pname") == {"": [65] * 5}


def test_x18_xml_leaves(spark):
    rows = post(spark, "text/xml", "<r><a x='1'/><b><c>5</c><c>66</c></b></r>")
    assert named(rows, "post") == {"r/a": [0], "r/b/c": [78, 78]}
    assert named(rows, "post_pname") == {"": [ord(c) if c == "/" else 65 for c in "r/ar/b/cr/b/c"]}
    assert named(post(spark, "text/xml", "<root>t</root>"), "post") == {"/root": [65]}


def test_x20_body_is_decoded_twice(spark):
    rows = post(spark, "application/x-www-form-urlencoded", quote("a=1&b=2", safe=""))
    assert named(rows, "post") == {"a": [78], "b": [78]}


def test_form_without_pairs_still_names(spark):
    rows = post(spark, "application/x-www-form-urlencoded", "flag")
    assert named(rows, "post") == {} and named(rows, "post_pname") == {"": [0]}


def test_x22_sparse_document_drops_falsy_fields(spark):
    df = spark.createDataFrame([("", 0, "x", None, 2.5)], "a string, b bigint, c string, d string, e double")
    assert json.loads(df.select(sparse_document(df)).first()[0]) == {"c": "x", "e": 2.5}


def test_x23_messages_are_parsed_never_evaluated(spark):
    values = spark.createDataFrame([('{"uri":"/a","flow_time":5}',), ("__import__('os')",), ("[1]",), ("",)], "value string")
    rows = parse_json_records(values).collect()
    assert [(r.parsed, r.uri, r.flow_time) for r in rows][0] == (True, "/a", 5)
    assert not any(r.parsed for r in rows[1:])


def test_many_parameters_in_one_record(spark):
    n = 3000
    uri = "/p?" + "&".join(f"k{i % (n // 2)}={i}" for i in range(n))
    rows = [r for r in extracted(spark, uri=uri) if r.p_type == "uri"]
    assert len(rows) == n // 2 and min(r.ord for r in rows) == n // 2


def test_last_of_equal_keys_survives_in_short_and_long_records(spark):
    """Records below and above the number of entries that are compared with each other."""
    from pyspark.sql import functions as F
    from wirewarden.operators.features import FEW, keep_last
    for n in (0, 1, 7, FEW, FEW + 1, 3 * FEW):
        made = [(f"k{i % 5}" if i % 3 else f"x{i}", "t", f"n{i}", str(i)) for i in range(n)]
        df = spark.createDataFrame([(made,)], "_entries array<struct<key:string,p_type:string,p_name:string,value:string>>")
        kept = keep_last(df, "_entries").first()["_entries"]
        wanted = {m[0]: (i, *m[1:]) for i, m in enumerate(made)}
        assert {e["key"]: (e["ord"], e["p_type"], e["p_name"], e["value"]) for e in kept} == wanted and len(kept) == len(wanted)


def test_queries_that_join_their_observations_extract_them_once(spark, sf):
    from wirewarden.catalog.queries import QUERIES
    for name in ("unmodelled_features", "modelled_features", "join_feature_model"):
        assert "events.parquet" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_json_body_is_parsed_once(spark):
    from pyspark.sql import functions as F
    from wirewarden.operators.bodies import json_pairs
    df = spark.createDataFrame([('{"a":1}',)], "t string").select(json_pairs(F.col("t")).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 1


def test_generated_methods_are_small_enough_to_be_compiled(spark, sf, capsys):
    """The JVM interprets a method beyond 8,000 bytes however often it runs."""
    records = derived.http_records(spark, sf)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for features in (extract_features(with_record_id(fill_empty(records))),
                         extract_features(detect._keyed(detect._requests(records)), carry=("record_id", "_content"))):
            features.explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
            assert sizes and max(sizes) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_stored_observations_are_read_by_column(spark, sf):
    observed = detect.observe(derived.http_records(spark, sf))
    plan = observed.select("p_id", "symbols")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_id:string,symbols:string>" in plan


def test_replaced_entries_leave_without_copies_of_the_arrays(spark):
    """Tokens are cut behind the explode, and only one projection holds the arrays of entries."""
    uri, cookie = "/p?a==b&=x&c=&a=9&flag&n=1", quote("n=7; =y; c=z; c=1=2")
    for more in ("", "".join(f"&k{i}={i}" for i in range(40))):
        rows = extracted(spark, uri=uri + more, cookie=cookie)
        kept = {(r.p_type, r.p_name): (r.ord, r.p_state) for r in rows if r.p_type in ("uri", "cookie")}
        n = 5 + more.count("&") + 1 + 1  # tokens of the line, its names, its path
        assert kept["uri", "a"] == (3, [78]) and not {("uri", "c"), ("uri", "n"), ("uri", ""), ("uri", "flag")} & set(kept)
        assert {name: v for (t, name), v in kept.items() if t == "cookie"} == {
            "n": (n, [78]), "": (n + 1, [65]), "c": (n + 3, [78, 78])}
    text = extract_features(frame(spark, [{"method": "GET", "uri": uri}]))._jdf.queryExecution().optimizedPlan().toString()
    assert "_placed" not in text and "array_position" not in text


def test_entries_replace_others_across_types_by_their_keys(spark):
    """Keys of types with different orders of host, path and method, in short and long records."""
    from wirewarden.operators.features import FEW
    from wirewarden.functions.text import WHITESPACE, is_blank, strip_text
    for more in ("", "".join(f"&k{i}=1" for i in range(FEW + 1))):
        # path GETGET + method reads the same both ways, so the empty name and the path share a key
        rows = extracted(spark, host="", uri="GETGET?=1&uri_pname=2" + more, http_type="T")
        keys = [r.p_id for r in rows]
        assert len(set(keys)) == len(keys) and named(rows, "uri_path") == {"": [65] * 6} and "" not in named(rows, "uri")
        assert named(rows, "uri")["uri_pname"] == [78]
        # without a method the list of names has the key of a parameter called like its type
        rows = extracted(spark, method="", uri="/p?uri_pname=2&cookie_pname=3" + more, cookie="c%3D1")
        assert "uri_pname" not in named(rows, "uri") and "cookie_pname" not in named(rows, "uri")
        assert {"uri_pname", "cookie_pname", "cookie", "uri_path"} <= {r.p_type for r in rows}
    texts = ["", " ", "a", " a", "a ", "　", "é", "　é ", "\x00", "~!", "\x7f ", "中\t", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_text(F.col("t")), is_blank(F.col("t")))
    assert [tuple(r)[1:] for r in df.collect()] == [
        (None, None) if t is None else (t.strip(WHITESPACE), t.strip(WHITESPACE) == "") for t in texts]


def test_rows_of_few_row_groups_are_dealt_out(spark, tmp_path):
    """One row group in a file of many splits is read by one task."""
    from wirewarden.session import dealt
    rows = spark.range(40000).select(F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 512).alias("x"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        given = spark.read.parquet(f"{tmp_path}/one")
        assert given.rdd.getNumPartitions() >= 8 and given.groupBy(F.spark_partition_id()).count().count() == 1
        out = dealt(given, "event_id")
        assert out.groupBy(F.spark_partition_id()).count().count() >= 8 and out.count() == 40000
        even = rows.repartition(8)
        assert dealt(even, "event_id") is even
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
