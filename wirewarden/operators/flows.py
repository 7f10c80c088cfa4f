"""Raw TCP flows -> HTTP records.

A flow is one direction of a connection; its file name carries time and
addresses. All parsing is column expressions over the flow text, so a flow is
read once and never leaves the JVM.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import strip_text, url_quote
from ..schemas import HTTP_FIELDS
from .requests import fill_empty

# Header names as they appear on the wire, and the record field each fills.
REQUEST_HEADERS = {
    "Host": "host", "User-Agent": "user_agent", "Cookie": "cookie", "Referer": "referer",
    "Content-Type": "content_type", "Content-Encoding": "content_encoding",
}
RESPONSE_HEADERS = {
    "Server": "server", "Content-Type": "content_type", "Content-Length": "content_length",
    "Date": "date", "Content-Encoding": "content_encoding",
}
# (?dm): only a line feed ends a line
_REQUEST_START = r"(?dm)(?=^(?:GET|POST) \S+ HTTP/1)"
_RESPONSE_START = r"(?dm)(?=^HTTP/1\.1 )"
_REQUEST_LINE = r"^(?:GET|POST) [ \t\x0B\f\r]*[^ \t\x0B\f\r\n]"
_NAME = r"^(\d+)T" + r"(\d+)\.(\d+)\.(\d+)\.(\d+)\.(\d+)-(\d+)\.(\d+)\.(\d+)\.(\d+)\.(\d+)"
_NAME_LENGTH = 54


def flow_text(content: Column) -> Column:
    """Bytes as UTF-8 text; a byte that is none becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def classify(text: Column) -> Column:
    """``Request``, ``Response`` or null by the first line of a message."""
    first = F.substring_index(text, "\n", 1)
    four = F.substring(first, 1, 4)
    return F.when(four.isin("GET ", "POST"), "Request").when(
        F.startswith(first, F.lit("HTTP/1.1 ")) & ~F.contains(first, F.lit(" Connection ")),
        "Response",
    )


def name_numbers(path: Column) -> Column:
    """The eleven numbers of a flow's file name (time, address and port of both
    sides), read once; null where the name isn't of that form."""
    name = F.substring(F.substring_index(path, "/", -1), 1, _NAME_LENGTH)
    numbers = F.regexp_extract_all(name, F.lit("[0-9]+"), F.lit(0))
    return F.when(name.rlike(_NAME), F.transform(numbers, lambda n: n.try_cast("bigint")))


def _located(numbers: Column) -> dict:
    """flow_time, addresses and ports, without the zero padding of the file name."""
    def text(i: int) -> Column:
        return F.get(numbers, F.lit(i)).cast("string")

    return {
        "flow_time": F.get(numbers, F.lit(0)),
        "src_ip": F.concat_ws(".", *[text(i) for i in range(1, 5)]),
        "src_port": text(5),
        "dst_ip": F.concat_ws(".", *[text(i) for i in range(6, 10)]),
        "dst_port": text(10),
    }


def flow_tuple(path: Column) -> dict:
    return _located(name_numbers(path))


def rejected_flows(flows: DataFrame) -> DataFrame:
    """Flows whose file name tells no time and addresses; ``parse_flows`` leaves them out."""
    return flows.where(F.get(name_numbers(F.col("path")), F.lit(0)).isNull()).select(
        "path", F.lit("unreadable name").alias("reason"))


def split_messages(flows: DataFrame, carry=("path",)) -> DataFrame:
    """One row per HTTP message of a flow: the ``carry`` columns, msg_no, kind, message.

    A flow that is none gives no parts rather than being filtered out: a filter
    would be pushed to wherever the text is made, and make it several times over.
    """
    text = flows.select(*carry, flow_text(F.col("content")).alias("text"))
    kinds = text.withColumn("kind", classify(F.col("text")))

    def parts_by(start: str, *lines: str) -> Column:
        # only a line that begins like a message can start another one
        more = [F.contains("text", F.lit("\n" + line)) for line in lines]
        return F.when(reduce(Column.__or__, more), F.split("text", start)).otherwise(F.array("text"))

    parts = F.when(F.col("kind") == "Request", parts_by(_REQUEST_START, "GET ", "POST ")).when(
        F.col("kind") == "Response", parts_by(_RESPONSE_START, "HTTP/1.1 "))
    return (
        kinds.select(*carry, F.posexplode_outer(parts).alias("msg_no", "message"))
        .withColumn("kind", classify(F.col("message")))
        .where("kind is not null")
    )


def _with_parts(messages: DataFrame) -> DataFrame:
    """Cut a message at its first blank line into header text and body."""
    # the message with a line feed before it, so that its first line can be blank, too
    lined = messages.withColumn("_lined", F.concat(F.lit("\n"), "message")).withColumns({
        "_lf": F.substring_index("_lined", "\n\n", 1), "_crlf": F.substring_index("_lined", "\n\r\n", 1)})
    by_lf = F.octet_length("_lf") < F.octet_length("_crlf")
    cut = lined.withColumns({
        "_front": F.when(by_lf, F.col("_lf")).otherwise(F.col("_crlf")), "_width": F.when(by_lf, 2).otherwise(3)})
    behind = F.substr("_lined", F.length("_front") + F.col("_width") + F.lit(1))
    return cut.withColumns({
        "head": F.substr("_front", F.lit(2)),
        "body": F.when(F.octet_length("_front") < F.octet_length("_lined"), behind).otherwise(F.lit("")),
    }).drop("_lined", "_lf", "_crlf", "_front", "_width")


def _header(name: str) -> Column:
    """Trimmed text of the last header line of that name, else the empty string."""
    mark = f"\n{name}: "
    value = F.substring_index(F.substring_index("head", mark, -1), "\n", 1)
    return strip_text(F.when(F.contains("head", F.lit(mark)), value).otherwise(F.lit("")))


def _second_word(line: str) -> Column:
    return F.regexp_extract("head", line + r" [ \t\x0B\f\r]*([^ \t\x0B\f\r\n]+)", 1)


def _request_fields() -> dict:
    length = _header("Content-Length")
    # a cast that fails costs an exception, and most requests have no such line
    length = F.when(length != "", length.try_cast("bigint").cast("string"))
    # blank lines inside a body are dropped, all its other lines are kept
    body = url_quote(F.regexp_replace("body", r"(?dm)^\r?\n", ""))
    method = F.when(F.startswith("head", F.lit("GET ")), "GET").when(
        F.startswith("head", F.lit("POST ")), "POST"
    )
    return {
        "method": method,
        "uri": url_quote(_second_word("^(?:GET|POST)")),
        "content_length": F.coalesce(length, F.lit("")),
        **{field: url_quote(_header(name)) for name, field in REQUEST_HEADERS.items()},
        "data": F.when(F.startswith("head", F.lit("POST ")), body).otherwise(F.lit("")),
    }


def _response_fields() -> dict:
    return {
        "status": url_quote(_second_word(r"^HTTP/1\.1")),
        **{field: url_quote(_header(name)) for name, field in RESPONSE_HEADERS.items()},
        # the body of a response ends at the next empty line
        "data": url_quote(F.split("body", r"(?dm)^\r\n", 2)[0]),
    }


def parse_messages(messages: DataFrame) -> DataFrame:
    """Requests and responses side by side in one pass: a field is read by the
    rule of the message's kind and is empty where the kind has no such field."""
    request, response = _request_fields(), _response_fields()
    is_request = F.col("kind") == "Request"
    fields = {
        name: F.when(is_request, request.get(name, F.lit(""))).otherwise(response.get(name, F.lit("")))
        for name in {**request, **response}
    }
    # a request line that is only a method names no resource; told by the message itself, not by fields cut from it
    named = messages.where((F.col("kind") == "Response") | F.col("message").rlike(_REQUEST_LINE))
    return _with_parts(named).withColumns({"http_type": F.col("kind"), **fields}).drop("head", "body", "message")


def parse_requests(messages: DataFrame) -> DataFrame:
    return parse_messages(messages.where("kind = 'Request'"))


def parse_responses(messages: DataFrame) -> DataFrame:
    return parse_messages(messages.where("kind = 'Response'"))


def parse_flows(flows: DataFrame) -> DataFrame:
    """All 19 fields of every message, plus ``record_id`` (file name and message number).

    A flow without a readable name is in ``rejected_flows``."""
    named = flows.withColumn("_numbers", name_numbers(F.col("path")))
    # without a text there are no messages
    readable = named.withColumn("content", F.when(F.get("_numbers", F.lit(0)).isNotNull(), F.col("content")))
    messages = parse_messages(split_messages(readable, ("path", "_numbers")))
    located = messages.withColumns(_located(F.col("_numbers"))).withColumn(
        "record_id", F.concat_ws("#", F.substring_index("path", "/", -1), "msg_no")
    )
    return fill_empty(located).select("record_id", *HTTP_FIELDS)
