"""Percent-coding, whitespace trimming and ``k=v`` splitting."""

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def url_quote(text: Column) -> Column:
    """Percent-encode UTF-8 text, leaving ``/`` and the unreserved characters."""
    out = F.url_encode(text)
    # url_encode is form encoding: blank becomes +, * stays, ~ and / are escaped
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def url_unquote(text: Column) -> Column:
    """Percent-decode; ``+`` stays and a ``%`` without two hex digits stays."""
    guarded = F.regexp_replace(
        F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25"
    )
    # a text without % is its own decoding
    return F.when(F.contains(text, F.lit("%")), F.url_decode(guarded)).otherwise(text)


def _plain(character: Column) -> Column:
    """Is it printable ASCII? Comparing one with all of WHITESPACE costs more than the rest of a trim."""
    return F.ascii(character).between(0x21, 0x7E)


def strip_text(text: Column) -> Column:
    stays = _plain(text) & _plain(F.right(text, F.lit(1)))
    return F.when(stays, text).otherwise(F.trim(text, F.lit(WHITESPACE)))


def is_blank(text: Column) -> Column:
    # trimming stops at the first character that stays
    return ~_plain(text) & (F.ltrim(text, F.lit(WHITESPACE)) == "")


def kv_name(token: Column) -> Column:
    return F.substring_index(token, "=", 1)


def kv_value(token: Column) -> Column:
    """Everything after the first ``=``, later ``=`` signs dropped: a=b=c -> bc."""
    behind = F.substr(token, F.length(kv_name(token)) + F.lit(2))
    return F.when(F.contains(token, F.lit("=")), F.replace(behind, F.lit("="), F.lit(""))).otherwise(token)
