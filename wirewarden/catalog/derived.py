"""HTTP traffic derived from the ``events`` and ``pages`` tables.

The given tables hold no HTTP traffic, so requests, responses, raw flows and
device messages are built from them row by row: their size grows with the
tables. One SQL text per view serves Spark and, through ``duckdb_ctes``, DuckDB.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import url_quote
from ..schemas import HTTP_FIELDS
from ..sources.documents import file_system
from ..session import dealt

QUOTED_FIELDS = ["referer", "host", "cookie", "uri", "user_agent", "content_type", "data"]
# Hand-set models by parameter name (start, transitions, means,
# variances, profile), among them one with a state that no other leads to.
HAND_MODELS = {
    "uid": ([1.0], [[1.0]], [78.0], [1.0], -2.5),
    "v": ([0.6, 0.4], [[0.7, 0.3], [0.2, 0.8]], [65.0, 78.0], [0.5, 2.0], -40.0),
    "name": ([0.5, 0.5], [[0.0, 1.0], [0.0, 1.0]], [65.0, 78.0], [1.0, 1.0], -5.0),
    "sid": ([0.2, 0.3, 0.5], [[0.5, 0.25, 0.25], [0.1, 0.6, 0.3], [0.0, 0.5, 0.5]], [65.0, 78.0, 47.0],
            [4.0, 9.0, 100.0], -70.0),
}
# The two-state model that the EM steps start from.
EM_MODEL = ([0.6, 0.4], [[0.7, 0.3], [0.2, 0.8]], [65.0, 78.0], [4.0, 9.0])
# The two-state model that several rounds start from, wide enough for every symbol, and their number.
EM_WIDE_MODEL = ([0.5, 0.5], [[0.6, 0.4], [0.4, 0.6]], [60.0, 80.0], [100.0, 150.0])
EM_ROUNDS = 3
# Every event whose id is a multiple of 97 carries an injected value in ``v``.
ATTACK_STEP = 97

_REQUESTS = """
select q.*,
  case when data = '' then '' else cast(length(data) as {S}) end as content_length,
  '' as status, '' as server, '' as date, '' as content_encoding
from (
  select cast(e.event_id as {S}) as record_id, e.event_id,
    {EPOCH} as flow_time, 'Request' as http_type,
    case e.event_type when 'error' then 'PUT' when 'purchase' then 'POST' when 'signup' then 'POST' else 'GET' end as method,
    regexp_extract(p.url, '^[a-z]+://[^/]*?([^./]+[.][^./]+)/', 1) as host,
    concat('/', regexp_extract(p.url, '^[a-z]+://[^/]+/([a-z]+)/', 1), '/', e.event_type,
      case when e.event_id % 29 = 0 then ';p=1' else '' end,
      '?uid=', cast(e.user_id as {S}), '&v=',
      case when e.event_id % 97 = 0 then concat('1%27 OR ''1''=''1', '<script>') else cast(e.value as {S}) end,
      case when e.event_id % 31 = 0 then '&uid=a=b=c&flag&empty=' else '' end,
      case when e.event_id % 89 = 0 then '&t=中文😀٣²+1%' else '' end,
      case when p.url like '%?page=%' then '&page=2&ref=x' else '' end,
      case when p.url like '%#top' then '#top' else '' end) as uri,
    case when e.event_id % 23 = 0 then '' else
      concat('sid=', md5(cast(e.user_id as {S})), '; uid=', cast(e.user_id as {S}),
        case when e.event_id % 37 = 0 then '; ; secure; theme=dark=1' else '' end) end as cookie,
    case when e.event_type = 'signup' then 'application/x-www-form-urlencoded'
         when e.event_type = 'purchase' and e.event_id % 11 = 0 then 'multipart/form-data'
         when e.event_type = 'purchase' and e.event_id % 2 = 0 then 'text/xml'
         when e.event_type = 'purchase' then 'application/json' else '' end as content_type,
    case when e.event_type = 'signup' then concat('name=u', cast(e.user_id as {S}), '&value=', cast(e.value as {S}), '&opt')
         when e.event_type = 'purchase' and e.event_id % 11 = 0 then '--b'
         when e.event_type = 'purchase' and e.event_id % 2 = 0 then concat('<r><h><uid>', cast(e.user_id as {S}), '</uid><none/></h>',
           case when e.event_id % 14 = 0 then '' else '</r>' end)
         when e.event_type = 'purchase' then concat('{"props":', e.props, ',"uid":"u', cast(e.user_id as {S}),
           '","ok":true,"none":null,"list":[1,2]', case when e.event_id % 7 = 0 then '' when e.event_id % 13 = 0 then '}{"b":2}'
           when e.event_id % 19 = 0 then '}]x' when e.event_id % 17 = 0 then '} tail' else '}' end)
         else '' end as data,
    p.url as referer, concat('agent/', cast(e.user_id % 5 as {S})) as user_agent,
    concat('10.0.0.', cast(e.user_id % 250 + 1 as {S})) as src_ip, cast(40000 + e.event_id % 20000 as {S}) as src_port,
    '10.10.10.1' as dst_ip, '80' as dst_port
  from {events} e join {pages} p on p.page_id = e.event_id % {N}) q
"""

_FLOWS = """
select concat(lpad(cast(flow_time as {S}), 10, '0'), 'T',
    case when method = 'PUT' then concat('010.010.010.001.00080-', client) else concat(client, '-010.010.010.001.00080') end) as path,
  case
    when method = 'PUT' and event_id % 5 = 0 then concat('HTTP/1.1 200 Connection established', {CRLF}, {CRLF})
    when method = 'PUT' then concat('HTTP/1.1 ', cast(200 + event_id % 4 * 100 as {S}), ' Done', {CRLF}, 'Server: srv/', cast(event_id % 3 as {S}), {CRLF},
      'Content-Type: text/html; charset=utf-8', {CRLF}, 'Content-Length: ', cast(length(referer) as {S}), {CRLF},
      'Date: day ', cast(event_id % 28 as {S}), {CRLF}, {CRLF}, referer, {LF}, 'second line', {CRLF}, {CRLF}, 'past the blank line',
      case when event_id % 3 = 0 then concat({CRLF}, 'HTTP/1.1 404 Not Found', {CRLF}, 'Server: other', {CRLF}, {CRLF}, 'gone') else '' end)
    else concat(method, ' ', replace(uri, ' ', '%20'), ' HTTP/1.1', {CRLF}, 'Host: ', host, {CRLF}, 'User-Agent: ', user_agent, {CRLF},
      case when cookie <> '' then concat('Cookie: ', cookie, {CRLF}) else '' end,
      case when event_id % 3 = 0 then concat('Referer: ', referer, {CRLF}) else '' end,
      case when data <> '' then concat('Content-Type: ', content_type, {CRLF}, 'Content-Length: ', cast(length(data) as {S}), {CRLF}) else '' end,
      case when event_id % 17 = 0 then '' else {CRLF} end,
      case when data = '' then '' when event_id % 17 = 0 then '' else concat(data, {CRLF}, {CRLF}, 'Host: in-body', {LF}) end,
      case when event_id % 13 = 0 then concat('GET /next?n=', cast(event_id as {S}), ' HTTP/1.1', {CRLF}, 'Host: second', {CRLF}, {CRLF}) else '' end)
  end as content
from (select r.*, concat('010.000.000.', lpad(split_part(src_ip, '.', 4), 3, '0'), '.', lpad(src_port, 5, '0')) as client from {http_requests} r) c
"""

_MESSAGES = """
select concat('ts', {SEP2}, cast({EPOCH} * 1000 as {S}), {SEP1}, 'sn', {SEP2}, 'dev', cast(e.user_id as {S})) as message from {events} e
"""


# What the requests take from a page's address; Spark cuts it once a page instead of once a request.
_PAGE_PARTS = {
    "_host": "regexp_extract(p.url, '^[a-z]+://[^/]*?([^./]+[.][^./]+)/', 1)",
    "_folder": "regexp_extract(p.url, '^[a-z]+://[^/]+/([a-z]+)/', 1)",
}


def _fill(text, dialect):
    spark = dialect == "spark"
    marks = {
        "{S}": "string" if spark else "varchar",
        "{EPOCH}": "unix_seconds(cast(e.ts as timestamp))" if spark else "cast(floor(epoch(e.ts)) as bigint)",
        "{CRLF}": "concat(chr(13), chr(10))", "{LF}": "chr(10)", "{SEP1}": "chr(1)", "{SEP2}": "chr(2)",
    }
    for mark, value in marks.items():
        text = text.replace(mark, value)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded requests, one per event."""
    events = dealt(table(spark, sf_dir, "events"), "event_id")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    sql = _fill(_REQUESTS, "spark").replace("{N}", str(pages.count()))
    sql = sql.replace("{events}", "events_in").replace("{pages}", "pages_in")
    for name, cut in _PAGE_PARTS.items():
        sql = sql.replace(cut, f"p.{name}")
    pages = pages.alias("p").select("*", *[F.expr(cut).alias(name) for name, cut in _PAGE_PARTS.items()])
    events.createOrReplaceTempView("events_in")
    pages.createOrReplaceTempView("pages_in")
    return spark.sql(sql)


def http_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests in wire form: text fields percent-encoded."""
    return http_requests(spark, sf_dir).select(
        "record_id", "event_id",
        *[url_quote(F.col(c)).alias(c) if c in QUOTED_FIELDS else F.col(c) for c in HTTP_FIELDS],
    )


def flow_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per captured flow: file name and bytes."""
    http_requests(spark, sf_dir).createOrReplaceTempView("http_requests_in")
    sql = _fill(_FLOWS, "spark").replace("{http_requests}", "http_requests_in")
    return spark.sql(sql).select("path", F.col("content").cast("binary").alias("content"))


def flow_files(spark: SparkSession, sf_dir: str, path: str):
    """The same flows as files of a folder; a file written twice is the same file."""
    def put(batches):
        system, root = file_system(path)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return flow_raw(spark, sf_dir).mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0]


def device_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("events_in")
    return spark.sql(_fill(_MESSAGES, "spark").replace("{events}", "events_in"))


def duckdb_quote(text):
    return f"replace(url_encode({text}), '%2F', '/')"


def duckdb_ctes(*names):
    """``with``-list entries for the views a DuckDB text needs."""
    requests = _fill(_REQUESTS, "duckdb").replace("{N}", "(select count(*) from pages)")
    fields = ", ".join(
        f"{duckdb_quote(c)} as {c}" if c in QUOTED_FIELDS else c for c in HTTP_FIELDS
    )
    texts = {
        "http_requests": requests.replace("{events}", "events").replace("{pages}", "pages"),
        "http_records": f"select record_id, event_id, {fields} from http_requests",
        "flow_raw": _fill(_FLOWS, "duckdb").replace("{http_requests}", "http_requests"),
        "device_messages": _fill(_MESSAGES, "duckdb").replace("{events}", "events"),
    }
    return ",\n".join(f"{name} as ({texts[name]})" for name in names)
