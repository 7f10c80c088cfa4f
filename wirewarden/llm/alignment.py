"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Both tokenizers cut the same bytes, so their tokens are aligned wherever a
token of each ends at one byte. Such a meeting is a link of the two tokens and
closes a group. Documents are numbered inside blocks. For every pair of ids a
block holds a bitmap of documents per binary digit (plane) of how often the
pair is linked in a document, compressed: a sorted list of numbers while that
is shorter than the bits. The planes of a pair OR-merged are its documents,
their popcount is the document count; popcounts weighted by the planes' powers
of two are the link count. Counts of the corpus are sums over blocks, moved as
one row for each pair and block. The postings then return each pair's count to
the documents that hold it: only pairs and counts go back to a block, the
bitmaps of a block are read once.
"""

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import frugal, in_small_batches, parts, store
from .packing import LONG_RUN, RUN, tokenizer_file

MARK = "▁"
#: characters of a block's texts
BLOCK = 4 << 20
#: pairs whose bits are laid out at once
ROWS = 4096


class Aligner:
    """Both vocabularies of a worker: A byte-level BPE (a rank file), B a SentencePiece model."""

    def __init__(self, ranks_path: str, model_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.ranks_path, self.slow = ranks_path, None
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        # the digits of every id with what follows it, in 8 bytes: A inside and at the end of a group, then B
        digits = [b"%d%s" % (i, end) for ids, ends in ((len(self.a_bytes), b",|"), (len(self.b_bytes), b",;"))
                  for end in (ends[:1], ends[1:]) for i in range(ids)]
        self.digits = np.array(digits, "S8").view("uint64")

    def encode_a(self, text: str) -> np.ndarray:
        """Ids by the tokenizer file's rules, added tokens as plain text; its own,
        slower encoder takes the very long runs of white space."""
        if len(text) >= RUN and LONG_RUN.search(text):
            if self.slow is None:
                import tokenizers
                self.slow = tokenizers.Tokenizer.from_file(tokenizer_file(self.ranks_path))
                self.slow.encode_special_tokens = True
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "int64")
        return np.array(self.a.encode_ordinary(text), "int64")

    def align(self, text: str | None):
        """(a ids, b ids, places of the links among a, among b), or None where a
        tokenizer doesn't give the text back with a space before it."""
        if not text:
            return None
        raw = (" " + text).encode("utf-8", "surrogatepass")
        b = self.b.encode(text, num_threads=1)
        if b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        a, b = self.encode_a(" " + text), np.array(b, "int64")
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        if a_end[-1] != len(raw):  # tokens of bytes spell what they cover
            return None
        at = np.searchsorted(a_end, b_end)
        met = a_end[at] == b_end
        return a, b, at[met], np.flatnonzero(met)

    def groups_text(self, a, b, at, bt) -> bytes:
        """The groups as ``a1,a2|b1;a3|b2,b3``."""
        a_in, b_in = np.diff(at, prepend=-1), np.diff(bt, prepend=-1)
        out = np.empty(len(a) + len(b), "int64")
        a_code, b_code = a.copy(), b + 2 * len(self.a_bytes)
        a_code[at] += len(self.a_bytes)
        b_code[bt] += len(self.b_bytes)
        out[np.arange(len(a)) + np.repeat(np.cumsum(b_in) - b_in, a_in)] = a_code
        out[np.arange(len(b)) + np.repeat(np.cumsum(a_in), b_in)] = b_code
        written = self.digits[out].view("uint8")
        return written[written != 0].tobytes()[:-1]


_LOADED = {}


def aligner(ranks_path, model_path) -> Aligner:
    """One for each worker and pair of files."""
    key = ranks_path, model_path
    if key not in _LOADED:
        _LOADED[key] = Aligner(*key)
    return _LOADED[key]


# bitmaps

def planes_of(pair, doc, times, n_pairs, n_docs):
    """Compressed bitmaps of each binary digit of ``times``: per plane the sizes of
    the lists (-1: bits), all lists, all rows of bits. Sorted by pair and document."""
    width, out = -(-n_docs // 8), []
    for k in range(int(times.max(initial=0)).bit_length()):
        on = (times >> k) & 1 > 0
        p, d = pair[on], doc[on]
        size = np.bincount(p, minlength=n_pairs)
        dense = 2 * size > width
        row = np.cumsum(dense) - 1
        bits = np.zeros((int(dense.sum()), n_docs), bool)
        bits[row[p[dense[p]]], d[dense[p]]] = True
        out.append({
            "sizes": np.where(dense, -1, size).astype("<i4").tobytes(),
            "lists": d[~dense[p]].astype("<u2").tobytes(), "bits": np.packbits(bits, axis=1).tobytes()})
    return out


def opened(plane, n_docs):
    """(sizes of the lists, lists, which pairs are dense, rows of bits) of a stored plane."""
    size = np.frombuffer(plane["sizes"], "<i4").astype("int64")
    dense = size < 0
    bits = np.frombuffer(plane["bits"], "uint8").reshape(int(dense.sum()), -(-n_docs // 8))
    return np.where(dense, 0, size), np.frombuffer(plane["lists"], "<u2").astype("int64"), dense, bits


def entries(plane, n_docs):
    """(pair, document) of every bit of a plane."""
    size, lists, dense, bits = opened(plane, n_docs)
    row, doc = np.nonzero(np.unpackbits(bits, axis=1, count=n_docs))
    return (np.concatenate([np.repeat(np.arange(len(size)), size), np.flatnonzero(dense)[row]]),
            np.concatenate([lists, doc]))


def counted(planes, n_pairs, n_docs):
    """(documents, links) of every pair: the popcount of its planes OR-merged, and
    the popcounts of the planes weighted by their powers of two."""
    documents, links = np.zeros((2, n_pairs), "int64")
    loaded = [opened(p, n_docs) for p in planes]
    starts = [np.cumsum(size) - size for size, *_ in loaded]
    rows = [np.cumsum(dense) - dense for _, _, dense, _ in loaded]
    for at in range(0, n_pairs, ROWS):
        end = min(n_pairs, at + ROWS)
        merged = np.zeros((end - at, -(-n_docs // 8)), "uint8")
        for k, (size, lists, dense, bits) in enumerate(loaded):
            one = np.zeros((end - at, n_docs), bool)
            first, last = starts[k][at], starts[k][end - 1] + size[end - 1]
            one[np.repeat(np.arange(end - at), size[at:end]), lists[first:last]] = True
            one = np.packbits(one, axis=1)
            some = np.flatnonzero(dense[at:end])
            one[some] = bits[rows[k][at + some]]
            merged |= one
            links[at:end] += np.bitwise_count(one).sum(axis=1, dtype="int64") << k
        documents[at:end] = np.bitwise_count(merged).sum(axis=1, dtype="int64")
    return documents, links


# blocks

_BLOCK = ("block long, doc_id array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, "
          "groups_sha256 array<string>, pairs array<long>, documents array<long>, links array<long>, "
          "planes array<struct<sizes:binary,lists:binary,bits:binary>>")


def _block_row(number, ids, texts, tools: Aligner):
    n_a, n_b, n_groups, shas, keys, n = [], [], [], [], [np.empty(0, "int64")], len(texts)
    width = len(tools.b_bytes)
    for k, text in enumerate(texts):
        found = tools.align(text)
        if found is None:
            n_a.append(0), n_b.append(0), n_groups.append(0), shas.append("")
            continue
        a, b, at, bt = found
        n_a.append(len(a)), n_b.append(len(b)), n_groups.append(len(at))
        shas.append(hashlib.sha256(tools.groups_text(a, b, at, bt)).hexdigest())
        keys.append((a[at] * width + b[bt]) * n + k)
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    held, pair = np.unique(key // n, return_inverse=True)
    planes = planes_of(pair, key % n, times, len(held), n)
    documents, links = counted(planes, len(held), n)
    return {"block": number, "doc_id": ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": shas,
            "pairs": held // width << 32 | held % width, "documents": documents, "links": links, "planes": planes}


def pair_bitmaps(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """A row for every block of documents: what is known of each, and the bitmaps of its pairs."""

    def run(frames):
        number = TaskContext.get().partitionId() << 32
        for frame in frames:
            for part in parts(frame, most=BLOCK):
                row = _block_row(number, part["doc_id"].tolist(), part["text"].tolist(), aligner(ranks_path, model_path))
                number += 1
                yield pd.DataFrame([row])

    named = in_small_batches(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return named.mapInPandas(frugal(run), _BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, documents, links, best) of the corpus from stored blocks;
    ``best``: no other A token is linked to the B token more often."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "documents", "links")).alias("p"))
    totals = each.groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.documents").alias("documents"), F.sum("p.links").alias("links"))
    totals = store(totals.select(
        "pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b_id"),
        "documents", "links"), "pair-counts")
    # one row for each id of B's vocabulary at most
    most = F.broadcast(totals.groupBy("b_id").agg(F.max("links").alias("_most")))
    return totals.join(most, "b_id").select(
        "pair", "a_id", "b_id", "documents", "links", (F.col("links") == F.col("_most")).alias("best"))


def _scores(rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Each document's links whose pair is the best, and the sum of its links' counts."""
    out = []
    for row in rows.itertuples():
        n = len(row.doc_id)
        # a block holds its pairs in their order
        in_order = counts.sort_values("pair")
        links, best = in_order["links"].to_numpy("int64"), in_order["best"].to_numpy("int64")
        n_best, total = np.zeros((2, n), "int64")
        for k, plane in enumerate(row.planes):
            pair, doc = entries(plane, n)
            np.add.at(total, doc, links[pair] << k)
            np.add.at(n_best, doc, best[pair] << k)
        out.append(pd.DataFrame({
            "doc_id": row.doc_id, "n_a": row.n_a, "n_b": row.n_b, "n_groups": row.n_groups, "n_links": row.n_groups,
            "n_best": n_best, "count_sum": total, "groups_sha256": row.groups_sha256}))
    return pd.concat(out)


_SCORED = ("doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")


def align_documents(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A text that is null or empty, or that a tokenizer doesn't give back to the
    byte, has no tokens: zeros and an empty digest. A repeated row counts as one
    more document. Extra columns are ignored, no rows give no rows. Every group
    ends in one link, so there are as many.
    """
    kind = docs.schema["doc_id"].dataType
    blocks = store(pair_bitmaps(docs, ranks_path, model_path), "pair-bitmaps")
    held = blocks.select("block", F.explode("pairs").alias("pair"))
    returned = held.join(pair_counts(blocks).select("pair", "links", "best"), "pair")
    # a second reading of the blocks, whose columns have names of their own
    again = blocks.select(*[F.col(c).alias(c) for c in (
        "block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "planes")])
    scored = again.groupBy("block").cogroup(returned.groupBy("block")).applyInPandas(_scores, _SCORED)
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind))
