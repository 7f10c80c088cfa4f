"""Body parsing: form, JSON and XML bodies -> ordered (name, value) pairs."""

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..functions import kv_name, kv_value, url_unquote

PAIRS = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("value", T.StringType()),
]))
# The content types a body is read by.
FORM, JSON, XML = "application/x-www-form-urlencoded", "application/json", "text/xml"


def body_kind(content_type: Column) -> Column:
    """form / json / xml by substring, null for anything else."""
    return (
        F.when(F.contains(content_type, F.lit(FORM)), "form")
        .when(F.contains(content_type, F.lit(JSON)), "json")
        .when(F.contains(content_type, F.lit(XML)), "xml")
    )


def let(value: Column, body) -> Column:
    """Bind a value once inside a lambda: body(value) without repeating it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def body_text(data: Column) -> Column:
    """A body is decoded twice, so encoded delimiters split values."""
    return let(url_unquote(data), url_unquote)


def token_pairs(text: Column, delimiter: str) -> Column:
    """``k=v`` tokens as pairs; a token without ``=`` gives none."""
    tokens = F.filter(F.split(text, delimiter), lambda t: F.contains(t, F.lit("=")))
    return F.transform(
        tokens, lambda t: F.struct(kv_name(t).alias("name"), kv_value(t).alias("value"))
    )


def json_pairs(text: Column) -> Column:
    """Top-level members in order; null for a body that is not one JSON object and nothing else.

    The parser ignores what follows the value it reads. So the body is read as
    the first element of a list whose second is a mark, its own hash: a body that
    ends early, or goes on behind its object, moves the mark or adds a member,
    and none can hold its own hash. One strict parse decides and reads.
    """
    def listed(mark):
        return F.from_json(
            F.concat(F.lit('[{"v":'), text, F.lit('},{"'), mark, F.lit('":{}}]')),
            "array<map<string,map<string,string>>>", {"allowSingleQuotes": "false"})

    def members(mark, items):
        body = F.map_values(F.get(items, F.lit(0)))
        pairs = F.transform(
            F.map_entries(F.get(body, F.lit(0))),
            lambda m: F.struct(m["key"].alias("name"), F.coalesce(m["value"], F.lit("")).alias("value")),
        )
        alone = (F.size(items) == 2) & (F.size(body) == 1)
        return F.when(alone & (F.get(F.map_keys(F.get(items, F.lit(1))), F.lit(0)) == mark), pairs)

    # bound, as every mention of the parsed list would parse the text again
    return let(F.md5(text), lambda mark: let(listed(mark), lambda items: members(mark, items)))


def xml_leaves(text: str):
    """(path, text) of every leaf element in document order; None if malformed."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return None
    leaves, todo = [], [("", root)]
    while todo:
        above, node = todo.pop()
        if len(node):
            here = f"{above}/{node.tag}" if above else node.tag
            todo.extend((here, child) for child in reversed(node))
        else:
            leaves.append({"name": f"{above}/{node.tag}", "value": node.text or ""})
    return leaves


@F.pandas_udf(PAIRS)
def xml_pairs(text: pd.Series) -> pd.Series:
    """No built-in walks the leaves of an XML text without a schema."""
    return text.map(xml_leaves, na_action="ignore").astype(object).where(text.notna(), None)
