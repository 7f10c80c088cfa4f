"""Request -> parameter observations.

Every generator yields the names and the texts of its entries; those of one record
are concatenated, exploded once and de-duplicated, in the same row. No generator
shuffles and the plan is the same for a table and for a stream.

Spark interprets lambdas, so none but the cutting of tokens and the sorting of long
records is one: keys, names and values are made in the generated code behind the explode.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import (
    encode_symbols,
    kv_name,
    kv_value,
    param_key,
    symbol_states,
    text_id,
    url_unquote,
)
from ..functions.ids import FIELD_TYPES, NAMED_TYPES
from ..functions.text import WHITESPACE, is_blank
from .bodies import PAIRS, body_kind, body_text, json_pairs, let, token_pairs, xml_pairs
from .requests import normalize

TEXTS = "array<string>"
# Entries of a record whose names are compared with each other rather than sorted.
FEW = 32
FEATURE_COLUMNS = ["p_id", "p_type", "p_name", "symbols", "ord"]


def prepare(records: DataFrame) -> DataFrame:
    """Decode a record once into the columns the generators share.

    Bodies come first: the Python step of XML bodies ends the method that Spark
    generates for the records' own plan, and the JVM compiles no method beyond
    8,000 bytes. The request line and the cookie are decoded behind it.
    """
    base = records.withColumn("body_kind", F.when(
        # absent data is null, which is no body either; is_blank would lengthen the method
        F.ltrim(F.col("data"), F.lit(WHITESPACE)) != "", body_kind(F.col("content_type"))
    )).withColumn("body", F.when(F.col("body_kind").isNotNull(), body_text(F.col("data"))))
    # only XML text reaches Python; every other row passes as null
    base = base.withColumn("xml_pairs", xml_pairs(F.when(F.col("body_kind") == "xml", F.col("body"))))
    return normalize(base).withColumns({
        "cookie_text": url_unquote(F.coalesce(F.col("cookie"), F.lit(""))),
        "body_pairs": F.when(F.col("body_kind") == "form", token_pairs(F.col("body"), "&"))
        .when(F.col("body_kind") == "json", json_pairs(F.col("body")))
        .when(F.col("body_kind") == "xml", F.col("xml_pairs"))
        .cast(PAIRS),
    }).drop("xml_pairs")


def _none() -> Column:
    return F.array().cast(TEXTS)


def _tokens(text: Column, delimiter: str) -> Column:
    return F.filter(F.split(text, delimiter), lambda t: F.contains(t, F.lit("=")))


def with_tokens(ready: DataFrame) -> DataFrame:
    """Add the ``k=v`` tokens of the request line and of the cookie."""
    return ready.withColumns({
        "uri_tokens": F.when(_has_payload(), _tokens(F.col("payload"), "&")).otherwise(_none()),
        "cookie_tokens": F.when(_has_cookie(), _tokens(F.col("cookie_text"), "; ")).otherwise(_none()),
    })


def _single(name: Column, value: Column, emit: Column):
    """At most one entry."""
    return F.when(emit, F.array(name)).otherwise(_none()), F.when(emit, F.array(value)).otherwise(_none())


def _list_name(p_type: str) -> Column:
    """The parameter name whose key is that of a list of names, null where there is none:
    ``name + method = method + p_type`` holds for one text at most."""
    text = F.concat(F.col("method_text"), F.lit(p_type))
    return F.when(F.endswith(text, F.col("method_text")), F.substr(text, F.lit(1), F.lit(len(p_type))))


def _joined_names(text: Column, delimiter: str, keep_blank: bool) -> Column:
    tokens = F.split(text, delimiter)
    if not keep_blank:
        tokens = F.filter(tokens, lambda t: ~is_blank(t))
    return F.array_join(F.transform(tokens, kv_name), "")


def _has_payload() -> Column:
    return ~is_blank(F.col("payload"))


def uri_entries():
    return F.transform("uri_tokens", kv_name), F.col("uri_tokens")


def uri_pname_entries():
    return _single(_list_name("uri_pname"), _joined_names(F.col("payload"), "&", keep_blank=True), _has_payload())


def uri_path_entries():
    # the key, host + method + path, is that of the empty name where both orders read the same
    path, method = F.col("path"), F.col("method_text")
    name = F.when(F.concat(path, method) == F.concat(method, path), F.lit(""))
    return _single(name, path, ~is_blank(path))


def http_type_entries():
    text = F.coalesce(F.col("http_type"), F.lit(""))
    return _single(F.lit("http_type"), text, ~is_blank(text))


def content_length_entries():
    """A length that is absent or zero is no observation."""
    text = F.coalesce(F.col("content_length").cast("string"), F.lit(""))
    return _single(F.lit("content_length"), text, ~is_blank(text) & (text != "0"))


def _has_cookie() -> Column:
    return ~is_blank(F.coalesce(F.col("cookie"), F.lit("")))


def cookie_entries():
    return F.transform("cookie_tokens", kv_name), F.col("cookie_tokens")


def cookie_pname_entries():
    names = _joined_names(F.col("cookie_text"), "; ", keep_blank=False)
    return _single(_list_name("cookie_pname"), names, _has_cookie())


def post_entries():
    pairs = F.col("body_pairs")
    return tuple(F.coalesce(pairs[part], _none()) for part in ("name", "value"))


def post_pname_entries():
    """Names that yielded a pair; a member repeated in a JSON object counts once."""
    names = F.col("body_pairs")["name"]
    names = F.when(F.col("body_kind") == "json", F.array_distinct(names)).otherwise(names)
    return _single(_list_name("post_pname"), F.array_join(names, ""), F.col("body_pairs").isNotNull())


# Names and texts of the entries of each type; the order decides which entry survives when two of a
# record share an id. Entries of a record share one if their names are equal: host, path and method
# are the record's. So an entry that has no name has the one that would lead to its key, or null.
GENERATORS = {
    "uri": uri_entries,
    "uri_pname": uri_pname_entries,
    "uri_path": uri_path_entries,
    "http_type": http_type_entries,
    "content_length": content_length_entries,
    "cookie": cookie_entries,
    "cookie_pname": cookie_pname_entries,
    "post": post_entries,
    "post_pname": post_pname_entries,
}


def _key(p_type: Column, name: Column) -> Column:
    """The text of ``param_key`` for a type that is a column; a field is named by its type."""
    host, path, method = F.col("host_text"), F.col("path"), F.col("method_text")
    return (
        F.when(p_type.isin(*NAMED_TYPES, *FIELD_TYPES), param_key("uri", host, path, method, name))
        .when(p_type == "uri_path", param_key("uri_path", host, path, method))
        .otherwise(F.concat(host, path, method, p_type))
    )


def _are_last(names: Column) -> Column:
    """Whether no later entry has the same name, for every entry of a record; null is no name.

    Sorting by (name, position) puts an entry right before the next of its name, and
    sorting by position puts the answers back in order: n log n per record at worst.
    """
    placed = F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("at")))
    return let(F.sort_array(placed), lambda ordered: F.sort_array(F.transform(
        F.arrays_zip(ordered.alias("this"), F.slice(ordered, F.lit(2), F.size(ordered)).alias("next")),
        lambda z: F.struct(z["this"]["at"].alias("at"), (
            z["next"].isNull() | z["this"]["name"].isNull() | (z["next"]["name"] != z["this"]["name"])).alias("last")),
    ))["last"])


def keep_last(df: DataFrame, entries: str) -> DataFrame:
    """Keep the last entry per key, with its place, inside the row: no shuffle, also in a stream."""
    placed = F.zip_with(
        F.transform(F.col(entries), lambda e, i: F.struct(
            e["key"].alias("key"), i.alias("ord"), e["p_type"].alias("p_type"),
            e["p_name"].alias("p_name"), e["value"].alias("value"),
        )),
        _are_last(F.col(entries)["key"]), lambda e, last: F.when(last, e))
    return df.withColumn(entries, F.filter(placed, lambda p: p.isNotNull()))


def explode_entries(ready: DataFrame, carry, kinds, dedupe: bool = True) -> DataFrame:
    """A row for every entry of the given generators that survives."""
    made = {kind: GENERATORS[kind]() for kind in kinds}
    types = [F.array_repeat(F.lit(kind), F.size(texts)) for kind, (_, texts) in made.items()]
    arrays = with_tokens(ready).select(
        *carry, "host_text", "path", "method_text", F.concat(*types).alias("_types"),
        F.concat(*[names for names, _ in made.values()]).alias("_names"),
        F.concat(*[texts for _, texts in made.values()]).alias("_texts"),
    )
    if dedupe:
        # the few entries of most records are compared with each other instead, behind the explode
        arrays = arrays.withColumn("_last", F.when(F.size("_names") > FEW, _are_last(F.col("_names"))))
    # The outer form: a plain explode makes Spark infer size(array) > 0 and push
    # it, with the whole array expression inlined, down to the scan or a join.
    rows = arrays.select("*", F.posexplode_outer("_texts").alias("ord", "_text")).where(F.col("ord").isNotNull())
    name, p_type = F.get("_names", F.col("ord")), F.get("_types", F.col("ord"))
    if dedupe:
        behind = F.slice("_names", F.col("ord") + F.lit(2), F.size("_names"))
        replaced = F.coalesce(F.array_contains(behind, name), F.lit(False))
        rows = rows.where(F.when(F.col("_last").isNotNull(), F.get("_last", F.col("ord"))).otherwise(~replaced))
    text = F.col("_text")
    return rows.select(
        *carry, "ord", "host_text", "path", "method_text", name.alias("_name"), p_type.alias("p_type"),
        F.when(p_type.isin("uri", "cookie"), kv_value(text)).otherwise(text).alias("_value"),
    ).select(
        *carry,
        text_id(_key(F.col("p_type"), F.col("_name"))).alias("p_id"),
        "p_type",
        F.when(F.col("p_type").isin(*NAMED_TYPES), F.col("_name")).otherwise(F.lit("")).alias("p_name"),
        encode_symbols(F.col("_value")).alias("symbols"),
        "ord",
    )


def generate(records: DataFrame, kind: str, carry=("record_id",)) -> DataFrame:
    """Observations of one generator, before the per-record de-duplication."""
    return explode_entries(prepare(records), list(carry), [kind], dedupe=False)


def extract_features(records: DataFrame, carry=("record_id", "flow_time"), dedupe=True) -> DataFrame:
    """All observations of all records, last writer per parameter id.

    ``carry`` names the record columns each observation keeps.
    """
    return explode_entries(prepare(records), list(carry), list(GENERATORS), dedupe)


def with_states(features: DataFrame) -> DataFrame:
    """Add ``p_state``, the observation sequence as code points."""
    return features.withColumn("p_state", symbol_states(F.col("symbols")))


def rejected_records(records: DataFrame) -> DataFrame:
    """Requests whose body announces a format it does not keep (dead letters)."""
    ready = prepare(records)
    return ready.where(F.col("body_kind").isNotNull() & F.col("body_pairs").isNull()).select(
        "record_id", F.concat(F.lit("malformed "), F.col("body_kind")).alias("reason"), "data"
    )
