"""DuckDB texts that compute the same rows as the registered queries.

They are written set-wise from the definition of each step and share no code
with the Spark side beyond the derived input views and fixed values.
"""

import math

from ..functions.symbols import cjk_class, digit_class
from ..functions.text import WHITESPACE
from ..schemas import ALARM_TYPE, HTTP_FIELDS
from .derived import EM_MODEL, EM_ROUNDS, EM_WIDE_MODEL, HAND_MODELS, duckdb_ctes, duckdb_quote

_WS = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
_FILLED = [f for f in HTTP_FIELDS if f != "flow_time"]


def unquote(text):
    return f"url_decode(replace({text}, '+', '%2B'))"


def strip(text):
    return f"trim({text}, {_WS})"


def symbols(text):
    letters = f"regexp_replace({text}, '[a-zA-Z]', 'A', 'g')"
    digits = f"regexp_replace({letters}, '[0-9]|{digit_class()}', 'N', 'g')"
    return f"regexp_replace({digits}, '{cjk_class()}', 'C', 'g')"


def states(text):
    codes = f"list_transform(string_split({symbols(text)}, ''), lambda ch: unicode(ch))"
    return f"case when {text} = '' then [0] else {codes} end"


def states_text(text):
    return f"array_to_string({states(text)}, ',')"


_KV_NAME = "string_split({t}, '=')[1]"
_KV_VALUE = "array_to_string(string_split({t}, '=')[2:], '')"


def _named(source, text, delimiter, p_type, grp, where="true"):
    """k=v tokens of a text column as feature entries."""
    return f"""
      select record_id, flow_time, {grp} as grp, pos, host_text || path || kv[1] || method_text as key,
        '{p_type}' as p_type, kv[1] as p_name, array_to_string(kv[2:], '') as value
      from (select *, string_split(tok, '=') as kv from (
        select *, unnest(range(len(string_split({text}, '{delimiter}')))) as pos,
          unnest(string_split({text}, '{delimiter}')) as tok from {source} where {where}))
      where len(kv) > 1"""


def _single(source, key, p_type, value, grp, where):
    return f"""
      select record_id, flow_time, {grp} as grp, 0 as pos, {key} as key, '{p_type}' as p_type, '' as p_name,
        {value} as value from {source} where {where}"""


def _names(text, delimiter, keep_blank):
    tokens = f"string_split({text}, '{delimiter}')"
    if not keep_blank:
        tokens = f"list_filter({tokens}, lambda t: {strip('t')} <> '')"
    return f"array_to_string(list_transform({tokens}, lambda t: string_split(t, '=')[1]), '')"


def _body_kind(content_type):
    return f"""case when contains({content_type}, 'application/x-www-form-urlencoded') then 'form'
      when contains({content_type}, 'application/json') then 'json'
      when contains({content_type}, 'text/xml') then 'xml' end"""


_HPM = "host_text || path || method_text"

# name -> (views it reads, text)
def _ln(p):
    return repr(math.log(p)) + "::double" if p else "'-infinity'::double"


def _hand_rows():
    def listed(values):
        return "[" + ", ".join(values) + "]"

    return ", ".join(
        f"('{name}', {len(start)}, {listed(map(_ln, start))}, {listed(listed(map(_ln, row)) for row in trans)}, "
        f"{listed(f'{m!r}::double' for m in means)}, {listed(f'{v!r}::double' for v in variances)}, {profile!r}::double)"
        for name, (start, trans, means, variances, profile) in HAND_MODELS.items())


def _density(x):
    return f"(-0.5 * ln(2 * pi() * vars[j]) - ({x} - means[j]) * ({x} - means[j]) / (2 * vars[j]))"


def _log_total(values):
    """ln of the sum of exponentials of a list."""
    return (f"[case when list_max(l) = '-infinity' then list_max(l) "
            f"else list_max(l) + ln(list_sum([exp(y - list_max(l)) for y in l])) end for l in [{values}]][1]")


VIEWS = {
    "requests": (["http_records"], "select * from http_records where method in ('GET', 'POST')"),
    "norm0": (["requests"], f"""
      select *, {strip(unquote('uri'))} as uri_text, {strip(unquote('host'))} as host_text,
        {strip(unquote('method'))} as method_text, {unquote('cookie')} as cookie_text,
        {unquote(unquote('data'))} as body, {_body_kind('content_type')} as body_kind from requests"""),
    "norm": (["norm0"], r"""
      select * exclude (p0, query, fragment),
        concat(regexp_extract(p0, '(?s)^(.*/)?([^/;]*)', 1), regexp_extract(p0, '(?s)^(.*/)?([^/;]*)', 2)) as path,
        trim(concat(regexp_extract(p0, '(?s)^(?:.*/)?[^/;]*;(.*)$', 1), query, fragment), '?') as payload
      from (select *, regexp_extract(uri_text, '(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) as p0,
        regexp_extract(uri_text, '(?s)^[^?#]*[?]([^#]*)', 1) as query,
        regexp_extract(uri_text, '(?s)^[^#]*#(.*)$', 1) as fragment from norm0)"""),
    "f_uri": (["norm"], _named("norm", "payload", "&", "uri", 1, f"{strip('payload')} <> ''")),
    "f_uri_pname": (["norm"], _single("norm", f"{_HPM} || 'uri_pname'", "uri_pname", _names("payload", "&", True), 2, f"{strip('payload')} <> ''")),
    "f_uri_path": (["norm"], _single("norm", "host_text || method_text || path", "uri_path", "path", 3, f"{strip('path')} <> ''")),
    "f_http_type": (["norm"], _single("norm", "host_text || path || 'http_type' || method_text", "http_type", "http_type", 4, f"{strip('http_type')} <> ''")),
    "f_content_length": (["norm"], _single("norm", "host_text || path || 'content_length' || method_text", "content_length", "content_length", 5,
                         f"{strip('content_length')} <> '' and content_length <> '0'")),
    "f_cookie": (["norm"], _named("norm", "cookie_text", "; ", "cookie", 6, f"{strip('cookie')} <> ''")),
    "f_cookie_pname": (["norm"], _single("norm", f"{_HPM} || 'cookie_pname'", "cookie_pname", _names("cookie_text", "; ", False), 7, f"{strip('cookie')} <> ''")),
    "f_post_form": (["norm"], _named("norm", "body", "&", "post", 8, "body_kind = 'form' and data <> ''")),
    "f_post_json": (["norm"], f"""
      select record_id, flow_time, 8 as grp, cast(j.rowid as bigint) as pos, host_text || n.path || j.key || method_text as key,
        'post' as p_type, j.key as p_name, coalesce(json_extract_string(j.value, '$'), '') as value
      from (select *, case when body_kind = 'json' and json_valid(body) then body else '{{}}' end as doc
            from norm where body_kind = 'json' and data <> '') n, json_each(n.doc) j"""),
    "f_post_xml": (["norm"], f"""
      select record_id, flow_time, 8 as grp, pos, host_text || path || p_name || method_text as key, 'post' as p_type, p_name,
        case when pos = 0 then regexp_extract(body, '<uid>([^<]*)</uid>', 1) else '' end as value
      from (select *, unnest([0, 1]) as pos, unnest(['r/h/uid', 'r/h/none']) as p_name from norm
            where body_kind = 'xml' and ends_with(body, '</r>'))"""),
    "f_post": (["f_post_form", "f_post_json", "f_post_xml"],
               "select * from f_post_form union all select * from f_post_json union all select * from f_post_xml"),
    "f_post_pname": (["norm", "f_post"], f"""
      select n.record_id, n.flow_time, 9 as grp, 0 as pos, {_HPM} || 'post_pname' as key, 'post_pname' as p_type, '' as p_name,
        coalesce((select string_agg(p.p_name, '' order by p.pos) from f_post p where p.record_id = n.record_id), '') as value
      from norm n where data <> '' and (body_kind = 'form' or (body_kind = 'json' and json_valid(body))
        or (body_kind = 'xml' and ends_with(body, '</r>')))"""),
    "f_all": (["f_uri", "f_uri_pname", "f_uri_path", "f_http_type", "f_content_length", "f_cookie", "f_cookie_pname", "f_post", "f_post_pname"],
              " union all ".join(f"select * from {v}" for v in (
                  "f_uri", "f_uri_pname", "f_uri_path", "f_http_type", "f_content_length", "f_cookie", "f_cookie_pname", "f_post", "f_post_pname"))),
    "entries": (["f_all"], f"""
      select record_id, flow_time, key, md5(key) as p_id, p_type, p_name, value, {states('value')} as st,
        cast(row_number() over (partition by record_id, grp order by pos) as bigint) as nth, grp, pos from f_all"""),
    "features": (["entries"], """
      select * from entries qualify row_number() over (partition by record_id, p_id order by grp desc, pos desc) = 1"""),
    "sequences": (["features"], """
      select p_id, array_to_string(st, ',') as states, any_value(st) as st, p_type, p_name, count(*) as weight, min(flow_time) as first_time
      from features group by all"""),
    "groups": (["features"], """
      select p_id, arg_min({'t': p_type, 'n': p_name}, {'a': flow_time, 'b': p_type, 'c': p_name}) as label, count(*) as n_seq,
        cast(round_even(avg(len(list_distinct(st))), 0) as int) as n_components, cast(sum(len(st)) as bigint) as n_symbols
      from features group by p_id"""),
    # the hand-set models, one row per parameter of that name
    "hand": ([], f"select * from (values {_hand_rows()}) h(p_name, k, lp, lt, means, vars, profile)"),
    "named": (["features", "hand"], "select distinct p_id, p_name from features where p_name in (select p_name from hand)"),
    "observed": (["features", "named"], """
      select f.record_id, f.p_id, f.p_name, f.st, array_to_string(f.st, ',') as states from features f join named n using (p_id)"""),
    "seen": (["observed", "hand"], """
      select o.*, k, lp, lt, means, vars, profile
      from (select p_name, states, any_value(st) as st from observed group by all) o join hand using (p_name)"""),
    "forward": (["seen"], f"""
      select p_name, states, 1 as t, [lp[j] + {_density('st[1]')} for j in range(1, k + 1)] as a from seen
      union all
      select f.p_name, f.states, f.t + 1,
        [{_log_total('[f.a[i] + lt[i][j] for i in range(1, k + 1)]')} + {_density('st[f.t + 1]')} for j in range(1, k + 1)]
      from forward f join seen s on s.p_name = f.p_name and s.states = f.states where f.t < len(s.st)"""),
    "scores": (["forward", "seen"], f"""
      select p_name, states, {_log_total('a')} as score, profile from forward join seen using (p_name, states) where t = len(st)"""),
    "scored": (["observed", "scores"], """
      select o.record_id, o.p_id, o.p_name, o.states, o.st, s.score, s.profile
      from observed o join scores s using (states, p_name)"""),
}
_START, _TRANS, _MEANS, _VARS = EM_MODEL
_EM_SUMS = ["loglik", "start0", "start1", "t00", "t01", "t10", "t11", "mass0", "mass1", "first0", "first1",
            "second0", "second1"]


def _em_density(j, x):
    return f"(-0.5 * ln(2 * pi() * {_VARS[j]}) - ({x} - {_MEANS[j]}) * ({x} - {_MEANS[j]}) / (2 * {_VARS[j]}))"


def _digits(value):
    return f"(case when abs({value}) < 1e5 then round({value}, 6) else round(({value}) / 1e10, 8) end + 0.0)"


def _two(u, v):
    return f"(greatest({u}, {v}) + ln(1 + exp(-abs(({u}) - ({v})))))"


def _into(j):
    return _two(f"a0 + ln({_TRANS[0][j]})", f"a1 + ln({_TRANS[1][j]})") + " + " + _em_density(j, "st[f.t + 1]")


def _from(i):
    return _two(*[f"ln({_TRANS[i][j]}) + {_em_density(j, 'st[f.t]')} + b{j}" for j in (0, 1)])


VIEWS.update({
    "em_seq": (["sequences"], "select states, any_value(st) as st from sequences group by states"),
    "em_forward": (["em_seq"], f"""
      select states, 1 as t, ln({_START[0]}) + {_em_density(0, 'st[1]')} as a0, ln({_START[1]}) + {_em_density(1, 'st[1]')} as a1 from em_seq
      union all
      select f.states, f.t + 1, {_into(0)}, {_into(1)} from em_forward f join em_seq s on s.states = f.states where f.t < len(s.st)"""),
    "em_backward": (["em_seq"], f"""
      select states, len(st) as t, 0.0::double as b0, 0.0::double as b1 from em_seq
      union all
      select f.states, f.t - 1, {_from(0)}, {_from(1)} from em_backward f join em_seq s on s.states = f.states where f.t > 1"""),
    "em_post": (["em_seq", "em_forward", "em_backward"], f"""
      select f.states, f.t, s.st, a0, a1, b0, b1, l.ll from em_forward f join em_backward b on b.states = f.states and b.t = f.t
      join em_seq s on s.states = f.states
      join (select f.states, {_two('a0', 'a1')} as ll from em_forward f join em_seq s on s.states = f.states where t = len(st)) l on l.states = f.states"""),
    "em_each": (["em_post"], f"""
      select states, any_value(ll) as loglik,
        {', '.join(f"sum(case when t = 1 then exp(a{j} + b{j} - ll) else 0 end) as start{j}" for j in (0, 1))},
        {', '.join(f"coalesce(sum(exp(a{i} + ln({_TRANS[i][j]}) + {_em_density(j, 'st[t + 1]')} + next{j} - ll)), 0) as t{i}{j}" for i in (0, 1) for j in (0, 1))},
        {', '.join(f"sum(exp(a{j} + b{j} - ll)) as mass{j}" for j in (0, 1))},
        {', '.join(f"sum(exp(a{j} + b{j} - ll) * (st[t] - {_MEANS[j]})) as first{j}" for j in (0, 1))},
        {', '.join(f"sum(exp(a{j} + b{j} - ll) * (st[t] - {_MEANS[j]}) * (st[t] - {_MEANS[j]})) as second{j}" for j in (0, 1))}
      from (select *, lead(b0) over w as next0, lead(b1) over w as next1 from em_post window w as (partition by states order by t)) p
      group by states"""),
    "em_total": (["em_each", "sequences"], f"""
      select p_id, cast(sum(weight) as bigint) as n_seq, {', '.join(f"sum(weight * {c}) as {c}" for c in _EM_SUMS)}
      from sequences join em_each using (states) group by p_id"""),
})
# Several rounds: every parameter has a model of its own, so each step of a sequence carries it along.
_MODEL = ["s0", "s1", "t00", "t01", "t10", "t11", "m0", "m1", "v0", "v1"]
_WIDE = [*EM_WIDE_MODEL[0], *EM_WIDE_MODEL[1][0], *EM_WIDE_MODEL[1][1], *EM_WIDE_MODEL[2], *EM_WIDE_MODEL[3]]


def _own_ln(x):
    return f"ln(greatest({x}, 1e-300))"


def _own_density(j, x):
    return f"(-0.5 * ln(2 * pi() * v{j}) - ({x} - m{j}) * ({x} - m{j}) / (2 * v{j}))"


def _own_into(j):
    return _two(f"a0 + {_own_ln(f't0{j}')}", f"a1 + {_own_ln(f't1{j}')}") + " + " + _own_density(j, "st[t + 1]")


def _own_from(i):
    return _two(*[f"{_own_ln(f't{i}{j}')} + {_own_density(j, 'st[t]')} + b{j}" for j in (0, 1)])


_CARRIED = ", ".join(_MODEL)
_DEV = {j: f"exp(a{j} + b{j} - ll) * (st[t] - m{j})" for j in (0, 1)}
VIEWS["em_own"] = (["sequences"], "select p_id, states, any_value(st) as st, sum(weight) as w from sequences group by p_id, states")
VIEWS["em_model0"] = (["em_own"], "select p_id, " + ", ".join(
    f"{v}::double as {n}" for n, v in zip(_MODEL, _WIDE)) + " from em_own group by p_id")
for _r in range(EM_ROUNDS):
    VIEWS |= {
        f"em_fwd{_r}": (["em_own", f"em_model{_r}"], f"""
          select p_id, states, st, {_CARRIED}, 1 as t, {_own_ln('s0')} + {_own_density(0, 'st[1]')} as a0,
            {_own_ln('s1')} + {_own_density(1, 'st[1]')} as a1 from em_own join em_model{_r} using (p_id)
          union all
          select p_id, states, st, {_CARRIED}, t + 1, {_own_into(0)}, {_own_into(1)} from em_fwd{_r} where t < len(st)"""),
        f"em_bwd{_r}": (["em_own", f"em_model{_r}"], f"""
          select p_id, states, st, {_CARRIED}, len(st) as t, 0.0::double as b0, 0.0::double as b1
          from em_own join em_model{_r} using (p_id)
          union all
          select p_id, states, st, {_CARRIED}, t - 1, {_own_from(0)}, {_own_from(1)} from em_bwd{_r} where t > 1"""),
        f"em_sums{_r}": ([f"em_fwd{_r}", f"em_bwd{_r}", "em_own"], f"""
          select p_id, sum(w * case when t = len(st) then ll else 0 end) as loglik, sum(case when t = 1 then w else 0 end) as n_seq,
            {', '.join(f"sum(case when t = 1 then w * exp(a{j} + b{j} - ll) else 0 end) as start{j}" for j in (0, 1))},
            {', '.join(f"coalesce(sum(w * exp(a{i} + {_own_ln(f't{i}{j}')} + {_own_density(j, 'st[t + 1]')} + next{j} - ll)), 0) as x{i}{j}" for i in (0, 1) for j in (0, 1))},
            {', '.join(f"sum(w * exp(a{j} + b{j} - ll)) as mass{j}" for j in (0, 1))},
            {', '.join(f"sum(w * {_DEV[j]}) as first{j}" for j in (0, 1))},
            {', '.join(f"sum(w * {_DEV[j]} * (st[t] - m{j})) as second{j}" for j in (0, 1))},
            {', '.join(f"any_value({n}) as {n}" for n in _MODEL)}
          from (select f.*, b0, b1, w, lead(b0) over places as next0, lead(b1) over places as next1,
              last_value({_two('a0', 'a1')}) over (places rows between unbounded preceding and unbounded following) as ll
            from em_fwd{_r} f join em_bwd{_r} b using (p_id, states, t) join em_own o using (p_id, states)
            window places as (partition by p_id, states order by t))
          group by p_id"""),
        f"em_model{_r + 1}": ([f"em_sums{_r}"], f"""
          select p_id, n_seq, loglik,
            {', '.join(f"start{j} / (start0 + start1) as s{j}" for j in (0, 1))},
            {', '.join(f"case when x{i}0 + x{i}1 > 0 then x{i}{j} / (x{i}0 + x{i}1) else 0 end as t{i}{j}" for i in (0, 1) for j in (0, 1))},
            {', '.join(f"case when mass{j} > 0 then m{j} + first{j} / mass{j} else m{j} end as m{j}" for j in (0, 1))},
            {', '.join(f"case when mass{j} > 0 then (0.01 + greatest(second{j} - first{j} / mass{j} * first{j}, 0)) / mass{j} else v{j} end as v{j}" for j in (0, 1))}
          from em_sums{_r}"""),
    }
_BASE = {
    "http_requests": [], "http_records": ["http_requests"],
    "flow_raw": ["http_requests"], "device_messages": [],
}


def text(select, *views):
    """``with`` all views the select needs, in dependency order."""
    order = []

    def need(name):
        if name in order:
            return
        for dep in _BASE[name] if name in _BASE else VIEWS[name][0]:
            need(dep)
        order.append(name)

    for view in views:
        need(view)
    parts = [duckdb_ctes(n) if n in _BASE else f"{n} as ({VIEWS[n][1]})" for n in order]
    return f"with recursive {', '.join(parts)}\n{select}" if parts else select


_FEATURE = "record_id, p_id, p_type, p_name, array_to_string(st, ',') as states"
_HEADERS = {"host": "Host", "user_agent": "User-Agent", "cookie": "Cookie", "referer": "Referer",
            "content_type": "Content-Type", "content_encoding": "Content-Encoding"}
_REPLIES = {"server": "Server", "content_type": "Content-Type", "content_length": "Content-Length",
            "date": "Date", "content_encoding": "Content-Encoding"}


def _header(name):
    # the last line of that name wins
    found = f"regexp_extract_all(head, '\\n{name}: ([^\\n]*)', 1)"
    return strip(f"coalesce(list_extract({found}, -1), '')")


_FIRST = "string_split(content, chr(10))[1]"
_KIND = """case when substr(string_split({t}, chr(10))[1], 1, 4) in ('GET ', 'POST') then 'Request'
  when starts_with({t}, 'HTTP/1.1 ') and not contains(string_split({t}, chr(10))[1], ' Connection ') then 'Response' end"""


def _number(i):
    """The i-th number of ``time T a.b.c.d.port - a.b.c.d.port``."""
    side, part = ("1", i - 1) if i < 7 else ("2", i - 6)
    digits = "split_part(path, 'T', 1)" if i == 1 else (
        f"split_part(split_part(split_part(substr(path, 1, 54), 'T', 2), '-', {side}), '.', {part})")
    return f"cast(cast({digits} as bigint) as varchar)"


_TUPLE = f"""cast({_number(1)} as bigint) as flow_time, concat_ws('.', {', '.join(_number(i) for i in range(2, 6))}) as src_ip,
  {_number(6)} as src_port, concat_ws('.', {', '.join(_number(i) for i in range(7, 11))}) as dst_ip, {_number(11)} as dst_port"""

VIEWS.update({
    "messages0": (["flow_raw"], f"""
      select path, unnest(range(len(parts))) as n, unnest(parts) as message from (
        select path, list_filter(string_split(case {_KIND.format(t='content')}
            when 'Request' then regexp_replace(content, '(?m)^((?:GET|POST) \\S+ HTTP/1)', chr(3) || '\\1', 'g')
            when 'Response' then regexp_replace(content, '(?m)^(HTTP/1\\.1 )', chr(3) || '\\1', 'g') end, chr(3)), lambda m: m <> '') as parts
        from flow_raw)"""),
    "messages": (["messages0"], f"""
      select * from (select path, cast(n as int) as msg_no, message, {_KIND.format(t='message')} as kind from messages0) where kind is not null"""),
    "parts": (["messages"], """
      select *, case when cut = '' then message else split_part(message, cut, 1) end as head,
        case when cut = '' then '' else substr(message, strpos(message, cut) + length(cut)) end as body
      from (select *, regexp_extract(message, '\\n\\r?\\n') as cut from messages)"""),
    "req_rows": (["parts"], f"""
      select path || '#' || msg_no as record_id, {_TUPLE}, 'Request' as http_type, method, {duckdb_quote('target')} as uri,
        coalesce(cast(try_cast(length_text as bigint) as varchar), '') as content_length,
        {', '.join(f"{duckdb_quote(_header(h))} as {f}" for f, h in _HEADERS.items())},
        case when method = 'POST' then {duckdb_quote("regexp_replace(body, '(?m)^\\r?\\n', '', 'g')")} else '' end as data,
        '' as status, '' as server, '' as date
      from (select *, regexp_extract(head, '^(GET|POST) +(\\S+)', 1) as method, regexp_extract(head, '^(GET|POST) +(\\S+)', 2) as target,
        {_header('Content-Length')} as length_text from parts where kind = 'Request')"""),
    "resp_rows": (["parts"], f"""
      select path || '#' || msg_no as record_id, {_TUPLE}, 'Response' as http_type,
        {duckdb_quote("regexp_extract(head, '^HTTP/1.1 +(\\S+)', 1)")} as status,
        {', '.join(f"{duckdb_quote(_header(h))} as {f}" for f, h in _REPLIES.items())},
        {duckdb_quote("case when starts_with(body, chr(13) || chr(10)) then '' else string_split(body, chr(10) || chr(13) || chr(10))[1] || case when contains(body, chr(10) || chr(13) || chr(10)) then chr(10) else '' end end")} as data,
        '' as method, '' as uri, '' as host, '' as user_agent, '' as cookie, '' as referer
      from parts where kind = 'Response'"""),
    "flow_records": (["req_rows", "resp_rows"], f"""
      select record_id, {', '.join(HTTP_FIELDS)} from req_rows union all select record_id, {', '.join(HTTP_FIELDS)} from resp_rows"""),
})

_FIELDS = ", ".join(HTTP_FIELDS)
_DOC_TEXT = f"select doc_id, {{}} from documents"

ORACLES = {
    "scan_json_archive": text(f"select {_FIELDS} from http_records", "http_records"),
    "scan_models": text("select p_id, label.t as p_type, label.n as p_name, n_seq, n_components, '1' as model_version from groups where n_seq >= 10", "groups"),
    "train_models": text("""select p_id, label.t as p_type, label.n as p_name, n_seq, n_components, 1.0::double as start_sum,
      n_components::double as transition_sum, true as has_variance, true as profile_below_mean from groups where n_seq >= 10""", "groups"),
    "to_json_record": text(f"select record_id, {_FIELDS} from http_records", "http_records"),
    "http_classify": text(f"select path, {_KIND.format(t='content')} as kind from flow_raw", "flow_raw"),
    "flow_tuple": text(f"select path, {_TUPLE} from flow_raw", "flow_raw"),
    "http_split_messages": text("select path, msg_no, kind, md5(message) as message_md5 from messages", "messages"),
    "http_parse_request": text("select record_id, method, uri, host, user_agent, cookie, referer, content_type, content_encoding, content_length, data from req_rows", "req_rows"),
    "http_parse_response": text("select record_id, status, server, content_type, content_length, date, content_encoding, data from resp_rows", "resp_rows"),
    "fill_empty": text("select record_id, http_type, cast(" + " + ".join(f"(case when {f} = '' then 1 else 0 end)" for f in _FILLED)
                       + " as int) as n_empty, status, data from flow_records", "flow_records"),
    "http_records_union": text("select http_type, method, status, count(*) as n, count(distinct src_ip) as n_src from flow_records group by all", "flow_records"),
    "parse_flows": text(f"select record_id, {_FIELDS} from flow_records", "flow_records"),
    "scan_flow_files": text(f"select record_id, {_FIELDS} from flow_records", "flow_records"),
    "stream_flow_files": text(f"select {_FIELDS} from flow_records", "flow_records"),
    "parse_json_record": text("select record_id, event_id % 7 <> 0 as parsed, " + ", ".join(
        f"case when event_id % 7 <> 0 then {f} end as {f}" for f in ("flow_time", "uri", "cookie", "data", "content_length")) + " from http_records", "http_records"),
    "filter_http_method": text("select record_id, method, uri from http_records where method in ('GET', 'POST')", "http_records"),
    "normalize_request": text("select record_id, uri_text, host_text, method_text, path, payload from norm", "norm"),
    "sparse_document": text("select record_id, cast(" + " + ".join(f"(case when {f} = '' then 0 else 1 end)" for f in _FILLED)
                            + " + (case when flow_time = 0 then 0 else 1 end) as int) as n_fields, "
                            "nullif(data, '') as data, nullif(cookie, '') as cookie, nullif(status, '') as status, flow_time from http_records", "http_records"),
    "rejected_records": text("""select record_id, 'malformed ' || body_kind as reason from norm
      where data <> '' and ((body_kind = 'json' and not json_valid(body)) or (body_kind = 'xml' and not ends_with(body, '</r>')))""", "norm"),
    "url_quote": _DOC_TEXT.format(f"md5({duckdb_quote('text')}) as quoted_md5, cast(length({duckdb_quote('text')}) as int) as n"),
    "url_unquote": f"select page_id, md5({unquote('html')}) as html_md5, {unquote(duckdb_quote('url'))} as url from pages",
    "url_unquote2": f"select page_id, md5({unquote(unquote('html'))}) as html_md5, {unquote(unquote(duckdb_quote(duckdb_quote('url'))))} as url from pages",
    "url_path": text("select record_id, path from norm", "norm"),
    "url_payload": text("select record_id, payload from norm", "norm"),
    "md5_id": _DOC_TEXT.format("md5(text) as id"),
    "param_id": text("""select record_id, md5(host_text || path || 'x' || method_text) as named_id, md5(host_text || method_text || path) as path_id,
      md5(host_text || path || 'http_type' || method_text) as http_type_id, md5(host_text || path || 'content_length' || method_text) as content_length_id,
      md5(host_text || path || method_text || 'uri_pname') as pname_id from norm""", "norm"),
    "encode_symbols": _DOC_TEXT.format(f"md5({states_text('text')}) as states_md5, cast(len({states('text')}) as int) as n_symbols"),
    "is_cjk": "select doc_id, regexp_matches(text, '[一-龦]') as has_cjk, regexp_matches(text || '中', '[一-龦]') as with_cjk from documents",
    "split_kv": text(f"""select record_id, cast(pos as int) as pos, {_KV_NAME.format(t='tok')} as p_name, {_KV_VALUE.format(t='tok')} as p_value from (
      select record_id, unnest(range(len(string_split(payload, '&')))) as pos, unnest(string_split(payload, '&')) as tok from norm) where contains(tok, '=')""", "norm"),
    "epoch_ms_day": "select event_id, strftime(ts, '%Y-%m-%d') as day from events",
    "device_fields": text("select message, strftime(make_timestamp(cast(split_part(split_part(message, chr(1), 1), chr(2), 2) as bigint) * 1000), '%Y-%m-%d') as day, "
                          "split_part(split_part(message, chr(1), 2), chr(2), 2) as device from device_messages", "device_messages"),
    "split_lines": "select doc_id, md5(line) as line_md5, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by all",
    "sequence_stats": text(f"select {_FEATURE}, cast(len(st) as int) as n_symbols, cast(len(list_distinct(st)) as int) as n_distinct from features", "features"),
    "concat_names": text(f"select record_id, {_names('payload', '&', True)} as uri_names, {_names('cookie_text', '; ', False)} as cookie_names from norm", "norm"),
    **{f"feat_{kind}": text(f"select record_id, md5(key) as p_id, p_type, p_name, {states_text('value')} as states from f_{kind}", f"f_{kind}")
       for kind in ("uri", "uri_pname", "uri_path", "http_type", "content_length", "cookie", "cookie_pname", "post_form", "post_json", "post_xml", "post_pname")},
    "post_dispatch": text("""select record_id, case when data <> '' then body_kind end as body_kind,
      cast((select count(*) from f_post p where p.record_id = n.record_id) as int) as n_pairs from norm n""", "norm", "f_post"),
    "extract_features": text(f"select {_FEATURE} from features", "features"),
    "dedupe_last_wins": text("""select record_id, p_id, count(*) as n_written, arg_max(p_type, grp * 1000000 + pos) as p_type,
      array_to_string(arg_max(st, grp * 1000000 + pos), ',') as states from entries group by record_id, p_id""", "entries"),
    "join_feature_model": text("select record_id, p_id, p_name, states, k as n_components from observed join hand using (p_name)", "observed", "hand"),
    "latest_model": text("""select p_id, arg_max(label, weight * 1000 + len(label)) as model_version, max(weight) as n_seq from (
      select p_id, p_type as label, count(*) as weight from features group by all) group by p_id""", "features"),
    "modelled_features": text("select record_id, p_id, p_type, p_name from features where p_id in (select p_id from named)", "features", "named"),
    "unmodelled_features": text("select record_id, p_id, p_type, p_name from features where p_id not in (select p_id from named)", "features", "named"),
    "group_sequences": text("select p_id, p_type, p_name, states, weight, first_time from sequences", "sequences"),
    "group_meta": text("select p_id, label.t as p_type, label.n as p_name from groups", "groups"),
    "min_support": text("select p_id, n_seq from groups where n_seq >= 10", "groups"),
    "hidden_state_count": text("select p_id, n_components from groups", "groups"),
    "train_groups": text("select p_id, label.t as p_type, label.n as p_name, n_seq, n_components, n_symbols from groups where n_seq >= 10", "groups"),
    "train_counts": text("select cast(sum(n_seq) as bigint) as n_features, count(*) as n_parameters, count(*) filter (n_seq >= 10) as n_effective from groups", "groups"),
    "train_counts_observed": text("select cast(sum(n_seq) as bigint) as n_features, count(*) as n_parameters, count(*) filter (n_seq >= 10) as n_effective, count(*) filter (n_seq >= 10) as n_models from groups", "groups"),
    "hmm_score": text("select record_id, p_id, states, round(score, 6) as score from scored", "scored"),
    "profile_min": text("select p_id, round(min(score), 6) as profile from scored group by p_id", "scored"),
    "score_3sigma": text("""select p_id, round(avg(score), 6) as score_mean, round(stddev_pop(score), 6) as score_std,
      min(score) < avg(score) - 3 * stddev_pop(score) - 1e-9 as outside from scored group by p_id""", "scored"),
    "worst_sequence": text("select p_id, arg_min(states, {'a': round(score, 9), 'b': states}) as states, round(min(score), 6) as score from scored group by p_id", "scored"),
    "detect_anomalies": text("select record_id, p_id, round(score, 6) as score, score < profile as is_anomaly from scored", "scored"),
    "alarm_projection": text(f"""select record_id, '{ALARM_TYPE}' as alarm_type, p_id, p_name, 'named' as p_type, profile as p_profile,
      round(score, 6) as score, sha256(record_id || '|' || p_id || '|1') as alarm_id from scored""", "scored"),
    "detect_batch": text(f"""select s.record_id, s.p_id, s.p_name, round(s.score, 6) as score, s.profile as p_profile,
      r.uri, r.src_ip, r.flow_time, '{ALARM_TYPE}' as alarm_type from scored s join requests r using (record_id) where s.score < s.profile""", "scored", "requests"),
    "count_day_device": text("""select strftime(make_timestamp(cast(split_part(split_part(message, chr(1), 1), chr(2), 2) as bigint) * 1000), '%Y-%m-%d')
      || '|' || split_part(split_part(message, chr(1), 2), chr(2), 2) as day_device, count(*) as n from device_messages group by 1""", "device_messages"),
    "transmat_repair": text("""
      , pairs as (select p_id, st[i] = 78 as a, st[i + 1] = 78 as b, count(*) as n
        from (select p_id, st, unnest(range(1, len(st))) as i from features) group by all),
      cells as (select p_id, coalesce(sum(n) filter (a and b), 0) as nn, coalesce(sum(n) filter (a and not b), 0) as nx,
        coalesce(sum(n) filter (not a and b), 0) as xn, coalesce(sum(n) filter (not a and not b), 0) as xx from pairs group by p_id)
      select p_id, case when nn + nx = 0 then 0.5 else round(nn / (nn + nx), 9) end as t00, case when nn + nx = 0 then 0.5 else round(nx / (nn + nx), 9) end as t01,
        case when xn + xx = 0 then 0.5 else round(xn / (xn + xx), 9) end as t10, case when xn + xx = 0 then 0.5 else round(xx / (xn + xx), 9) end as t11 from cells""", "features"),
    "hmm_train_single_state": text("""
      , one as (select p_id, st from features where p_id in (select p_id from groups where n_seq >= 10 and n_components = 1)),
      obs as (select p_id, unnest(st) as x from one),
      model as (select p_id, avg(x) as mean, count(*) as n from obs group by p_id),
      var as (select p_id, mean, (0.01 + sum((x - mean) * (x - mean))) / any_value(n) as v from obs join model using (p_id) group by p_id, mean),
      seq as (select p_id, list_sum(list_transform(st, lambda x: -0.5 * ln(2 * pi() * v) - (x - mean) * (x - mean) / (2 * v))) as score from one join var using (p_id))
      select p_id, count(*) as n_seq, round(any_value(mean), 6) as mean, round(any_value(v), 9) as variance, round(min(score), 5) as profile from seq join var using (p_id) group by p_id""",
      "features", "groups"),
    "rejected_archive_lines": text("""select method, count(*) as n, true as kept from http_records
      where event_id % 7 <> 0 and event_id % 11 <> 0 group by 1
      union all select case when event_id % 7 = 0 then 'cut' else 'mistyped' end, count(*), false from http_records
      where event_id % 7 = 0 or event_id % 11 = 0 group by 1""", "http_records"),
    "stream_archive_rejects": text("""select method, count(*) as n, cast(sum(flow_time) as bigint) as time_sum, true as kept
      from http_records where event_id % 7 <> 0 group by 1
      union all select '60', count(*), null, false from http_records where event_id % 7 = 0""", "http_records"),
    "rejected_messages": text("""select substr(message, 1, 8) as message, count(*) as n from device_messages
      where ends_with(message, '3') group by 1""", "device_messages"),
    "rejected_flows": text("""select http_type, count(*) as n from flow_records
      where not ends_with(split_part(record_id, '#', 1), '3') group by 1
      union all select 'unreadable name', count(*) from flow_raw where ends_with(path, '3')""", "flow_records", "flow_raw"),
    "stream_archive": text(f"select {_FIELDS} from http_records", "http_records"),
    "stream_detect": text(f"""select distinct r.flow_time, r.src_port, r.uri, s.p_id, s.p_name, round(s.score, 6) as score,
      s.profile as p_profile, '{ALARM_TYPE}' as alarm_type
      from scored s join http_records r using (record_id) where s.score < s.profile""", "scored", "http_records"),
    "stream_documents": text("""select flow_time, nullif(method, '') as method, nullif(uri, '') as uri, nullif(cookie, '') as cookie,
      nullif(data, '') as data from (select distinct on (""" + _FIELDS + """) * from http_records)""", "http_records"),
    "stream_document_source": text("""select flow_time, nullif(method, '') as method, nullif(uri, '') as uri, nullif(cookie, '') as cookie,
      nullif(data, '') as data from (select distinct on (""" + _FIELDS + """) * from http_records)""", "http_records"),
    "stream_counts": text("""select strftime(make_timestamp(cast(split_part(split_part(message, chr(1), 1), chr(2), 2) as bigint) * 1000), '%Y-%m-%d')
      || '|' || split_part(split_part(message, chr(1), 2), chr(2), 2) as day_device, cast(count(*) as bigint) as n from device_messages group by 1""", "device_messages"),
    "stream_late_counts": text(""", timed as (select make_timestamp(cast(split_part(split_part(message, chr(1), 1), chr(2), 2) as bigint) * 1000) as sent,
        split_part(split_part(message, chr(1), 2), chr(2), 2) as device from device_messages),
      told as (select strftime(sent, '%Y-%m-%d') as day, device, cast(floor(epoch(sent)) as bigint) % 2 = 1
        and cast(sent as date) < (select max(cast(sent as date)) from timed where cast(floor(epoch(sent)) as bigint) % 2 = 0) - 1 as late from timed)
      select day, device, late, cast(count(*) as bigint) as n from told group by all""", "device_messages"),
    "em_sums": text("select p_id, n_seq, " + ", ".join(
        f"case when abs(loglik / n_seq) > 1e5 and abs({c} / n_seq) < 1e5 then round({c} / n_seq, 3) + 0.0 else {_digits(f'{c} / n_seq')} end as {c}"
        for c in _EM_SUMS) + " from em_total", "em_total"),
    # the variance prior adds 0.01 to the squares
    "em_step": text("select p_id, " + ", ".join([
        *[f"{_digits(f'start{j} / (start0 + start1)')} as startprob{j}" for j in (0, 1)],
        *[f"case when t{i}0 + t{i}1 > 0.01 then {_digits(f't{i}{j} / (t{i}0 + t{i}1)')} end as transmat{2 * i + j}" for i in (0, 1) for j in (0, 1)],
        *[f"case when mass{j} > 0.01 then {_digits(f'{_MEANS[j]} + first{j} / mass{j}')} end as means{j}" for j in (0, 1)],
        *[f"case when mass{j} > 0.01 then {_digits(f'(0.01 + greatest(second{j} - first{j} / mass{j} * first{j}, 0)) / mass{j}')} end as vars{j}" for j in (0, 1)],
    ]) + " from em_total", "em_total"),
    # a state that is never left moves on uniformly once the fit has ended
    "em_rounds": text(f"select p_id, {EM_ROUNDS} as n_iter, {_digits('loglik / n_seq')} as loglik, " + ", ".join([
        *[f"{_digits(f's{j}')} as startprob{j}" for j in (0, 1)],
        *[f"case when t{i}0 + t{i}1 = 0 then 0.5 else {_digits(f't{i}{j}')} end as transmat{2 * i + j}" for i in (0, 1) for j in (0, 1)],
        *[f"{_digits(f'{c}{j}')} as {name}{j}" for c, name in (("m", "means"), ("v", "vars")) for j in (0, 1)],
    ]) + f" from em_model{EM_ROUNDS}", f"em_model{EM_ROUNDS}"),
}
