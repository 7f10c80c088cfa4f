"""Character-class encoding of a value into its observation sequence.

A sequence travels as a string (one character per observation), which is a
cheaper grouping and shuffle key than an integer array; ``symbol_states`` turns
it into code points where numbers are needed.
"""

import string
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Class symbols, and the inclusive range read as Chinese.
LETTER, DIGIT, CJK = "A", "N", "C"
CJK_FIRST, CJK_LAST = 0x4E00, 0x9FA6
EMPTY = "\x00"


@lru_cache(maxsize=None)
def digit_ranges():
    """Code-point ranges of every non-ASCII character str.isdigit() accepts.

    This is wider than the decimal-digit category: superscripts, circled and
    parenthesised digits count as well.
    """
    ranges = []
    for code in range(0x80, 0x110000):
        if chr(code).isdigit():
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return tuple(map(tuple, ranges))


@lru_cache(maxsize=None)
def digit_class():
    """The same ranges as a regex class, in a spelling Java and RE2 share."""
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in digit_ranges()) + "]"


def cjk_class():
    return f"[\\x{{{CJK_FIRST:x}}}-\\x{{{CJK_LAST:x}}}]"


def is_cjk(text: Column) -> Column:
    """Does the text hold a character of the Chinese range?"""
    return F.regexp_like(text, F.lit(cjk_class()))


def encode_symbols(text: Column) -> Column:
    """ASCII letter -> A, digit -> N, Chinese -> C, others as they are."""
    ascii_done = F.translate(
        text,
        string.ascii_letters + string.digits,
        LETTER * len(string.ascii_letters) + DIGIT * len(string.digits),
    )
    wide_done = F.regexp_replace(
        F.regexp_replace(ascii_done, digit_class(), DIGIT), cjk_class(), CJK
    )
    only_ascii = F.octet_length(text) == F.length(text)
    return (
        F.when(text == "", F.lit(EMPTY)).when(only_ascii, ascii_done).otherwise(wide_done)
    )


def symbol_states(symbols: Column) -> Column:
    """Encoded sequence -> array of code points; the empty value is [0]."""
    return F.transform(F.split(symbols, ""), lambda ch: F.ascii(ch))
