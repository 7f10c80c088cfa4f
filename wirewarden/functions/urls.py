"""URL parts by plain string cuts.

``parse_url`` rejects quotes, blanks and angle brackets, which are what an
attack string is made of, so the generic URI syntax is cut by hand. The cuts
build on each other, so they are staged projections: every stage names its
result once instead of repeating its expression inside the next one.
"""

from pyspark.sql import Column, DataFrame, functions as F

# Schemes whose last path segment may carry ;parameters.
PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtspu", "sip", "sips",
    "mms", "sftp", "tel",
)


def _after(text: str, mark: str) -> Column:
    """What follows the first ``mark``, else the empty string."""
    behind = F.substr(F.col(text), F.length(F.substring_index(text, mark, 1)) + F.lit(2))
    return F.when(F.contains(text, F.lit(mark)), behind).otherwise(F.lit(""))


def with_url_parts(df: DataFrame, url: str) -> DataFrame:
    """Add ``path`` and ``payload`` of the URL column.

    ``path`` excludes the ``;parameters`` of the last segment. ``payload`` is
    parameters, query and fragment joined without separators, ``?`` trimmed.
    """
    rest = df.columns
    cuts = df.select(
        *rest, F.substring_index(url, "#", 1).alias("_front"), _after(url, "#").alias("_fragment")
    ).select(
        *rest, "_fragment", F.substring_index("_front", "?", 1).alias("_head"),
        _after("_front", "?").alias("_query"),
    )
    rooted = F.startswith("_head", F.lit("/")) & ~F.startswith("_head", F.lit("//"))
    bare = F.regexp_replace("_head", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/]*)?", "")
    scheme = F.lower(F.regexp_extract("_head", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    whole = cuts.select(
        *rest, "_fragment", "_query",
        F.when(rooted, F.col("_head")).otherwise(bare).alias("_path"),
        (rooted | scheme.isin(*PARAM_SCHEMES)).alias("_may_have_params"),
    ).withColumn("_last", F.substring_index("_path", "/", -1))
    placed = whole.withColumn(
        "_at",
        F.when(
            F.col("_may_have_params") & F.contains("_last", F.lit(";")),
            F.length("_path") - F.length("_last") + F.length(F.substring_index("_last", ";", 1)) + 1,
        ).otherwise(F.lit(0)),
    )
    path, at = F.col("_path"), F.col("_at")
    params = F.when(at > 0, F.substr(path, at + F.lit(1))).otherwise(F.lit(""))
    return placed.select(
        *rest,
        F.when(at > 0, F.substr(path, F.lit(1), at - F.lit(1))).otherwise(path).alias("path"),
        F.trim(F.concat(params, F.col("_query"), F.col("_fragment")), F.lit("?")).alias("payload"),
    )
