"""Record-level projections and filters."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import strip_text, url_unquote, with_url_parts
from ..schemas import HTTP_FIELDS, HTTP_METHODS, HTTP_RECORD


def parse_json_records(df: DataFrame, value: str = "value") -> DataFrame:
    """JSON text (string or bytes) -> the 19 record fields next to the other columns.

    ``parsed`` tells whether the text was a JSON object; such a row without it
    belongs into the dead-letter table.
    """
    text = F.col(value).cast("string")
    # the corrupt-record column is the one sign that survives an object whose fields are all absent
    schema = T.StructType([*HTTP_RECORD.fields, T.StructField("_bad", T.StringType())])
    options = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    rest = [c for c in df.columns if c != value and c not in HTTP_FIELDS]
    return (
        df.withColumn("_rec", F.from_json(text, schema, options))
        .withColumn("parsed", F.col("_rec").isNotNull() & F.col("_rec._bad").isNull())
        .select(*rest, value, "parsed", *[
            F.when(F.col("parsed"), F.col(f"_rec.{c}")).alias(c) for c in HTTP_FIELDS
        ])
    )


def fill_empty(df: DataFrame) -> DataFrame:
    """Give a frame all 19 fields; an absent text field is the empty string."""
    kinds = {f.name: f.dataType.simpleString() for f in HTTP_RECORD}
    rest = [c for c in df.columns if c not in HTTP_FIELDS]
    filled = []
    for c in HTTP_FIELDS:
        given = F.col(c).cast(kinds[c]) if c in df.columns else F.lit(None).cast(kinds[c])
        filled.append((given if kinds[c] == "bigint" else F.coalesce(given, F.lit(""))).alias(c))
    return df.select(*rest, *filled)


def with_record_id(df: DataFrame) -> DataFrame:
    """Key a record by its queue position where there is one, else by its content."""
    if "record_id" in df.columns:
        return df
    if {"topic", "partition", "offset"} <= set(df.columns):
        key = F.concat_ws(":", "topic", "partition", "offset")
    else:
        key = F.md5(F.to_json(F.struct(*HTTP_FIELDS)))
    return df.withColumn("record_id", key)


def http_requests_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("method").isin(*HTTP_METHODS))


def normalize(df: DataFrame) -> DataFrame:
    """Add the decoded request line: uri_text, host_text, method_text, path, payload."""
    fields = {"uri_text": "uri", "host_text": "host", "method_text": "method"}
    decoded = df.withColumns({text: url_unquote(F.coalesce(F.col(c), F.lit(""))) for text, c in fields.items()})
    return with_url_parts(decoded.withColumns({text: strip_text(F.col(text)) for text in fields}), "uri_text")


def present(name: str, dtype: str) -> Column:
    """The field, or null where it is falsy: empty text, zero, false."""
    col = F.col(name)
    if dtype == "string":
        return F.when(col != "", col)
    if dtype == "boolean":
        return F.when(col, col)
    if dtype in ("int", "bigint", "double", "float", "smallint", "tinyint"):
        return F.when(col != 0, col)
    return col


def sparse_document(df: DataFrame, always=()) -> Column:
    """JSON text of a row without its falsy fields; ``always`` fields stay unless null."""
    fields = [
        F.col(c).alias(c) if c in always else present(c, t).alias(c) for c, t in df.dtypes
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
