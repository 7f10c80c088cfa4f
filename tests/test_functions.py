"""Scalar functions against Python's own, on generated and hand-picked strings."""

from urllib.parse import quote, unquote, urlparse

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wirewarden.functions import encode_symbols, is_cjk, kv_name, kv_value, strip_text, symbol_states, url_quote, url_unquote, with_url_parts
from wirewarden.functions.messages import device_day_key

TEXT = st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=30)
MIXED = st.text(st.sampled_from("aZ09+%/;?#&=. ~*'<中😀٣²\n"), max_size=20)
ONE_JOB = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, values, make):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, s string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("s"))).collect()]


@ONE_JOB
@given(st.lists(TEXT | MIXED, min_size=200, max_size=200))
def test_quote(spark, values):
    assert column(spark, values, url_quote) == [quote(v) for v in values]


@ONE_JOB
@given(st.lists(TEXT | MIXED, min_size=200, max_size=200))
def test_unquote(spark, values):
    values = values + [quote(v) for v in values] + ["%", "%4", "%zz%41", "a+b", "%%41"]
    # escapes that are no UTF-8 become replacement characters, of which Java may write another number
    values = [v for v in values if "�" not in unquote(v)]
    assert column(spark, values, url_unquote) == [unquote(v) for v in values]


@ONE_JOB
@given(st.lists(TEXT, min_size=200, max_size=200))
def test_strip(spark, values):
    values = [f" \t\r\n{v}　\xa0" for v in values] + values
    assert column(spark, values, strip_text) == [v.strip() for v in values]


def python_parts(url):
    p = urlparse(url)
    return p.path, (p.params + p.query + p.fragment).strip("?")


URLS = st.text(st.sampled_from("ab/;?#&=.:'<> %中"), max_size=20).map(lambda s: "/" + s.lstrip("/"))


@ONE_JOB
@given(st.lists(URLS, min_size=300, max_size=300))
def test_url_parts(spark, urls):
    urls = urls + ["http://h.example/a/b;p=1?q=2#f", "//h/x;y", "", "?", "a;b/c;d", "?a=1", "#f?x", "*", "/a?b?c#d#e", "?q??"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = [(r.path, r.payload) for r in with_url_parts(df, "u").orderBy("i").collect()]
    assert got == [python_parts(u) for u in urls]


def python_states(text):
    def one(ch):
        if ch.isascii() and ch.isalpha():
            return 65
        if ch.isdigit():
            return 78
        return 67 if "一" <= ch <= "龦" else ord(ch)
    return [one(ch) for ch in text] or [0]


@ONE_JOB
@given(st.lists(TEXT | MIXED, min_size=300, max_size=300))
def test_symbols(spark, values):
    values = values + ["", "²①⑴", "龦龧", "😀é٣", "NAC1中"]
    assert column(spark, values, lambda c: symbol_states(encode_symbols(c))) == [python_states(v) for v in values]


def test_every_digit_character(spark):
    digits = [chr(c) for c in range(0x110000) if chr(c).isdigit()]
    assert set(column(spark, digits, encode_symbols)) == {"N"}


@pytest.mark.parametrize("token, expected", [("a=b=c", ("a", "bc")), ("a=", ("a", "")), ("=x", ("", "x")), ("a=b", ("a", "b"))])
def test_kv(spark, token, expected):
    assert (column(spark, [token], kv_name)[0], column(spark, [token], kv_value)[0]) == expected


def test_device_key(spark):
    messages = ["ts\u00021500000000000\u0001sn\u0002d1", "broken", "ts\u0002x\u0001sn\u0002d"]
    assert column(spark, messages, device_day_key) == ["2017-07-14|d1", None, None]


def test_bounds_of_the_chinese_range(spark):
    # the first and the last character of the range count, their neighbours and wider planes don't
    values = [chr(0x4DFF), chr(0x4E00), chr(0x9FA6), chr(0x9FA7), chr(0x20000), "a" + chr(0x4E00)]
    assert column(spark, values, is_cjk) == [False, True, True, False, False, True]
    assert column(spark, values, encode_symbols) == [values[0], "C", "C", values[3], values[4], "AC"]
