"""Best-fit packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing: pieces by falling length, each into the sequence with the
smallest remaining capacity that holds it, found in a segment tree over the
remaining capacities. Pieces of one length are alike, so the packing is a plan
over the histogram of lengths (``capacity`` counts at most): the plan moves
whole ranges of sequences, its size depends on the capacity and not on the
number of documents, and every piece finds its place by its number among the
pieces of its length.
"""

import base64
import json
import re
import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import map_documents, numbered, slices_for, store

PIECES = "piece int, start long, length long, ids_crc32 long"


class RemainingTree:
    """Segment tree over remaining capacities 0..n: which of them have open
    sequences, and the smallest such capacity that is at least a given one."""

    def __init__(self, n):
        self.size = 1 << n.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity, on):
        i = capacity + self.size
        self.any[i] = on
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, capacity):
        i = capacity + self.size
        if self.any[i]:
            return capacity
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int):
    """Best-fit decreasing over counted lengths: rules (length, first, count,
    sequence, per, offset). Pieces first.. of a length go to sequences
    sequence.. in order, ``per`` to each, from ``offset`` on."""
    tree, open_ranges, rules, sequences = RemainingTree(capacity), {}, [], 0

    def put(left, begin, n):
        if n and left:
            open_ranges.setdefault(left, deque()).append((begin, n))
            tree.set(left, True)

    for length in sorted(histogram, reverse=True):
        first, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, begin = capacity, sequences
                n = -(-todo // (capacity // length))
                sequences += n
            else:
                begin, n = open_ranges[left].popleft()
                if not open_ranges[left]:
                    tree.set(left, False)
            per = left // length
            full = min(n, todo // per)
            rest = min(todo - full * per, per) if full < n else 0
            offset = capacity - left
            if full:
                rules.append((length, first, full * per, begin, per, offset))
                put(left - per * length, begin, full)
            if rest:
                rules.append((length, first + full * per, rest, begin + full, rest, offset))
                put(left - rest * length, begin + full, 1)
            put(left, begin + full + bool(rest), n - full - bool(rest))
            first += full * per + rest
            todo -= full * per + rest
    return rules


#: white space (Unicode's property) in one run so long that tiktoken's pattern may run out of stack, at about a million
RUN = 100_000
_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
LONG_RUN = re.compile(rf"(?<![{_SPACE}])[{_SPACE}]{{{RUN},}}")

_ENCODERS = {}


def byte_bpe(ranks_path: str):
    """The byte-level BPE of a rank file, one for each Python worker, with the
    added tokens of the tokenizer file beside it. Its ids equal those of that
    file (tested)."""
    if ranks_path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        with open(tokenizer_file(ranks_path), "rb") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        _ENCODERS[ranks_path] = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODERS[ranks_path]


def tokenizer_file(ranks_path: str) -> str:
    return ranks_path.removesuffix(".tiktoken") + ".json"


def encode(text: str, ranks_path: str) -> list[int]:
    """The ids that the tokenizer file gives ``text`` without special tokens around
    it; an added token that the text spells out is one id. A text with a very
    long run of white space goes to that file's own, slower encoder."""
    if len(text) >= RUN and LONG_RUN.search(text):
        path = tokenizer_file(ranks_path)
        if path not in _ENCODERS:
            import tokenizers
            _ENCODERS[path] = tokenizers.Tokenizer.from_file(path)
        return _ENCODERS[path].encode(text, add_special_tokens=False).ids
    return byte_bpe(ranks_path).encode(text, allowed_special="all")


def cut_lengths(total: int, capacity: int):
    """Lengths of a document's pieces: all full but the first, which takes the rest."""
    first = total % capacity
    return [first] * (first > 0) + [capacity] * (total // capacity)


def tokenise(docs: DataFrame, ranks_path: str, capacity: int, end_id: int) -> DataFrame:
    """A row for every piece: doc_id, piece, start, length, ids_crc32. A null
    text is empty; every document ends in ``end_id``, so none is without a piece."""

    def pieces(frames):
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                ids = np.array([*encode(text or "", ranks_path), end_id], "<u4")
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids), capacity)):
                    out.append((doc, piece, start, length, zlib.crc32(ids[start:start + length].tobytes())))
                    start += length
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_documents(docs.select("doc_id", "text"), pieces, PIECES)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces no longer than ``capacity``.

    The histogram of lengths (at most ``capacity`` rows) is all that reaches
    the driver. Pieces of one length are numbered by (doc_id, piece, start,
    ids_crc32); equal rows take any order. No pieces: no rows.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    rules = np.array(sorted(plan(histogram, capacity)), "int64").reshape(-1, 6)
    # one sorted key for (length, first) lets a piece find its rule by binary search
    span = 1 + max(histogram.values(), default=0)
    sent = spark.sparkContext.broadcast((rules[:, 0] * span + rules[:, 1], rules))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        keys, table = sent.value
        rule = table[np.searchsorted(keys, length.to_numpy() * span + number.to_numpy(), side="right") - 1]
        inside = number.to_numpy() - rule[:, 1]
        return pd.DataFrame({
            "sequence_id": rule[:, 3] + inside // rule[:, 4],
            "offset": rule[:, 5] + inside % rule[:, 4] * length.to_numpy()})

    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "_number",
                      slices_for(sum(histogram.values())))
    return ranked.withColumn("_place", place("length", "_number")).select(
        *pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, ranks_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Only documents longer than ``capacity`` are cut. A null or empty text is
    its end id alone. Extra columns are ignored; repeated rows are packed each.
    """
    return pack(store(tokenise(docs, ranks_path, capacity, end_id), "pieces"), capacity)
