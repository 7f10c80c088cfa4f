"""Parameter identity: md5 over host, path, name and method in a per-type order."""

from pyspark.sql import Column, functions as F

NAMED_TYPES = ("uri", "cookie", "post")
FIELD_TYPES = ("http_type", "content_length")
NAME_LIST_TYPES = ("uri_pname", "cookie_pname", "post_pname")


def text_id(text: Column) -> Column:
    return F.md5(text)


def param_key(p_type: str, host: Column, path: Column, method: Column, name=None) -> Column:
    """The text whose md5 is the parameter id.

    The type is not part of the id of uri, cookie and post parameters: a name
    used in two places of the same request line shares one model.
    """
    if p_type in NAMED_TYPES:
        return F.concat(host, path, name, method)
    if p_type == "uri_path":
        return F.concat(host, method, path)
    if p_type in FIELD_TYPES:
        return F.concat(host, path, F.lit(p_type), method)
    if p_type in NAME_LIST_TYPES:
        return F.concat(host, path, method, F.lit(p_type))
    raise ValueError(f"unknown parameter type {p_type}")
