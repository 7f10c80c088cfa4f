"""Benchmark decontamination by suffix arrays of the training texts.

A shard is a stretch of documents inside a task. Its suffix array orders the
places at which a run of benchmark words begins; places in runs too short to
hold any window can match none and are left out. Every suffix of every
benchmark item is binary-searched in it, a word deeper at each step, which
yields the interval of places where the suffix's window occurs and, further
down, its longest verbatim match. Shards are independent, so nothing is
shuffled; the benchmark is what is sent, in blocks of bounded size.
"""

import re
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, frugal, in_small_batches, parts, store
from .shingles import mix

#: words of a window, characters of a shard, bytes of benchmark text searched at a time
WINDOW, SHARD, BLOCK_BYTES = 10, 4 << 20, 16 << 20
#: bytes hashed at once, and the longest word that is hashed with others
CHUNK, LONG = 1 << 22, 256

_LETTER = np.zeros(256, bool)
_LETTER[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True
_VALUES = mix(np.arange(1, 257, dtype="uint64"))
_POWERS = np.cumprod(np.full(LONG, 0x9E3779B97F4A7C15, "uint64"), dtype="uint64")
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")


def _hash_chunk(raw: bytes):
    data = np.frombuffer(raw, "uint8")
    letter = _LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.empty(0, "uint64"), begin
    data = data[letter]
    start = np.flatnonzero(first[letter])
    length = np.diff(start, append=len(data))
    place = np.arange(len(data)) - np.repeat(start, length)
    hashes = mix(np.add.reduceat(_VALUES[data] * _POWERS[np.minimum(place, LONG - 1)], start))
    for i in np.flatnonzero(length > LONG):
        hashes[i] = xxhash.xxh3_64_intdigest(data[start[i]:start[i] + length[i]].tobytes())
    return hashes, begin


def word_hashes(raw: bytes):
    """Hash and first byte of every word of UTF-8 text; A-Z count as a-z."""
    raw, at, found = raw.lower(), 0, []
    while at < len(raw):
        cut = _BREAK.search(raw, at + CHUNK) if len(raw) - at > CHUNK else None
        end = cut.start() if cut else len(raw)
        hashes, begin = _hash_chunk(raw[at:end])
        found.append((hashes, begin + at))
        at = end
    if not found:
        return np.empty(0, "uint64"), np.empty(0, "int64")
    return np.concatenate([h for h, _ in found]), np.concatenate([b for _, b in found])


def joined(texts):
    """Hashes of the words of all texts, the text of each word."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, begin = word_hashes(b"\0".join(raw))
    ends = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.searchsorted(ends, begin, side="right")


def ranges(starts, ends):
    """All numbers of the ranges, one range after the other."""
    size = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def suffix_array(words, depth, least):
    """Places of all words that stand in a run of at least ``least`` known ones
    (0 is unknown), ordered by up to ``depth`` words from the place to the run's
    end; equal ones by place. Ranks of 1, 2, 4... words are sorted by pairs."""
    known = np.concatenate([[False], words > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= max(1, least)
    starts, ends = starts[long], ends[long]
    at, end = ranges(starts, ends), np.repeat(ends, ends - starts)
    rank = np.zeros(len(words) + 1, "int64")
    rank[at] = words[at]
    step, distinct, top = 1, 0, int(words.max(initial=0)) + 1
    while step < depth and distinct < len(at):
        pair = rank[at] * top + np.where(at + step < end, rank[np.minimum(at + step, len(words))], 0)
        values, inverse = np.unique(pair, return_inverse=True)
        rank[at] = inverse + 1
        step, distinct = 2 * step, len(values)
        top = distinct + 1
    return at[np.argsort(rank[at], kind="stable")]


def _bisect(words, array, depth, low, high, wanted, right):
    """First index of [low, high) whose word at ``depth`` is not below (right: above) the wanted one."""
    low, high, end = low.copy(), high.copy(), len(words) - 1
    while (still := low < high).any():
        middle = (low + high) >> 1
        # where the search is over, any place will do
        word = words[np.minimum(array[np.minimum(middle, len(array) - 1)] + depth, end)]
        below = word <= wanted if right else word < wanted
        low = np.where(still & below, middle + 1, low)
        high = np.where(still & ~below, middle, high)
    return low


class Benchmark:
    """The words, suffixes and windows of benchmark items, ready to be searched for."""

    def __init__(self, items, window=WINDOW):
        #: names in string order, so that sorted numbers are sorted names
        self.names = sorted({str(i) for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(self.names)}
        hashes, item = joined([text for _, text in items])
        self.vocabulary = np.unique(hashes)
        count = np.bincount(item, minlength=len(items)) if len(items) else np.zeros(0, "int64")
        need = np.minimum(count, window)
        # a break behind every item; suffixes shorter than their item's window are not looked for
        self.words = np.zeros(len(hashes) + len(items), "int64")
        self.words[np.arange(len(hashes)) + item] = np.searchsorted(self.vocabulary, hashes) + 1
        first = np.cumsum(np.concatenate([[0], count + 1]))[:-1] if len(items) else count
        windows = np.where(count > 0, count - need + 1, 0)
        owner = np.repeat(np.arange(len(items)), windows)
        inside = ranges(np.zeros(len(items), "int64"), windows) if len(items) else owner
        self.start, self.need, self.length = first[owner] + inside, need[owner], count[owner] - inside
        self.depth, self.least = int(self.length.max(initial=0)), int(self.need.min(initial=window))
        groups, self.items_of = {}, []
        self.group = np.zeros(len(self.start), "int64")
        for s, (at, n, i) in enumerate(zip(self.start, self.need, owner)):
            g = self.group[s] = groups.setdefault(self.words[at:at + n].tobytes(), len(groups))
            if g == len(self.items_of):
                self.items_of.append(set())
            if items[i][0] is not None:
                self.items_of[g].add(number[str(items[i][0])])
        buckets = self.vocabulary >> np.uint64(44)
        self.bucket = np.zeros(1 << 20, bool)
        self.bucket[buckets.astype("int64")] = True
        self._listed = {}

    def ids(self, hashes):
        """Number of each word from 1; 0 for one that no item has."""
        out = np.zeros(len(hashes), "int64")
        maybe = np.flatnonzero(self.bucket[(hashes >> np.uint64(44)).astype("int64")])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), max(0, len(self.vocabulary) - 1))
        same = self.vocabulary[place] == hashes[maybe] if len(self.vocabulary) else np.zeros(0, bool)
        out[maybe[same]] = place[same] + 1
        return out

    def search(self, words, array):
        """Binary search of every suffix, word by word: (low, high) of the interval in
        which its window occurs, and the length of the longest match at every index."""
        found_low, found_high = np.zeros((2, len(self.start)), "int64")
        longest = np.zeros(len(array), "int32")
        alive = np.arange(len(self.start)) if len(array) else np.empty(0, "int64")
        low, high = np.zeros(len(alive), "int64"), np.full(len(alive), len(array))
        depth = 0
        while len(alive):
            wanted = self.words[self.start[alive] + depth]
            low, high = (_bisect(words, array, depth, low, high, wanted, right) for right in (False, True))
            some = low < high
            alive, low, high, depth = alive[some], low[some], high[some], depth + 1
            whole = self.need[alive] == depth
            found_low[alive[whole]], found_high[alive[whole]] = low[whole], high[whole]
            deep = self.need[alive] <= depth
            begin, which = np.unique(low[deep], return_index=True)
            longest[ranges(begin, high[deep][which])] = depth
            more = self.length[alive] > depth
            alive, low, high = alive[more], low[more], high[more]
        return found_low, found_high, longest

    def listed(self, groups):
        """Names of the items that own one of these windows, in string order."""
        if groups not in self._listed:
            if len(self._listed) >= 10_000:
                self._listed.clear()
            self._listed[groups] = [self.names[i] for i in sorted(set().union(*(self.items_of[g] for g in groups)))]
        return self._listed[groups]

    def matches(self, texts):
        """For each text of a shard: its number of words, the stretches of words that
        are hit, the items they belong to, and the first longest match (start, length)."""
        hashes, text = joined(texts)
        words = np.zeros(len(hashes) + len(texts) + 1, "int64")  # a break behind every text
        words[np.arange(len(hashes)) + text] = self.ids(hashes)
        count = np.bincount(text, minlength=len(texts))
        first = np.cumsum(np.concatenate([[0], count + 1]))[:-1]
        array = suffix_array(words, self.depth, self.least)
        low, high, longest = self.search(words, array)
        # equal windows have one interval: each is laid out once
        _, one = np.unique(self.group, return_index=True)
        one = one[high[one] > low[one]]
        place = array[ranges(low[one], high[one])]
        group = np.repeat(self.group[one], high[one] - low[one])
        cover = np.zeros(len(words) + 1, "int64")
        np.add.at(cover, place, 1)
        np.add.at(cover, place + np.repeat(self.need[one], high[one] - low[one]), -1)
        edges = np.flatnonzero(np.diff(np.cumsum(cover) > 0, prepend=False))
        owner = np.searchsorted(first, edges[::2], side="right") - 1
        hits, groups, best = ([[] for _ in texts] for _ in range(3))
        for t, a, b in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist()):
            hits[t].append((a - int(first[t]), b - int(first[t])))
        where = np.searchsorted(first, place, side="right") - 1
        pairs = np.unique(where * max(1, len(self.items_of)) + group)
        for t, g in zip((pairs // max(1, len(self.items_of))).tolist(), (pairs % max(1, len(self.items_of))).tolist()):
            groups[t].append(g)
        matched = np.flatnonzero(longest)
        matched = matched[np.lexsort((array[matched], -longest[matched]))]
        texts_of = np.searchsorted(first, array[matched], side="right") - 1
        which, at = np.unique(texts_of, return_index=True)
        for t, m in zip(which.tolist(), matched[at].tolist()):
            best[t] = [(int(array[m]) - int(first[t]), int(longest[m]))]
        return [(int(n), h, self.listed(tuple(g)), b[0] if b else None) for n, h, g, b in zip(count, hits, groups, best)]


_FOUND = ("n_words long, hits array<struct<start:long,end:long>>, items array<string>, "
          "longest struct<start:long,length:long>")


def _searcher(spark, benchmark):
    sent = spark.sparkContext.broadcast(benchmark)

    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def run(series):
            for texts in series:
                out = []
                for shard in parts(pd.DataFrame({"text": texts}), most=SHARD):
                    out += sent.value.matches(shard["text"].tolist())
                yield pd.DataFrame(out, columns=["n_words", "hits", "items", "longest"])
        yield from frugal(run)(batches)

    return search


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The items, as lists of bounded text; one list if they are few."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = -(-size // block_bytes) or 1
    own = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(count))
    for k in range(count):
        yield [(r[0], r[1]) for r in rows.where(own == k).distinct().collect()]


def _summed(hits) -> F.Column:
    """Words covered by stretches that may overlap."""
    def add(state, r):
        new = F.greatest(r["end"] - F.greatest(r["start"], state["to"]), F.lit(0).cast("long"))
        return F.struct((state["n"] + new).alias("n"), F.greatest(state["to"], r["end"]).alias("to"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.array_sort(hits), zero, add)["n"]


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``found``: n_words, hits (stretches of words inside
    occurring windows), items (names, in string order), longest (the first of the
    longest verbatim matches: start, length; null without a hit).

    Words are runs of letters a-z (A-Z taken as such), digits and everything
    beyond ASCII. A window is ``window`` words of an item, the whole of a shorter
    one. Items without words hit nothing; items without an id hit but are not
    listed; an id that repeats is one item. A null or empty text has no words.
    Repeated documents have equal results, all other columns are kept (one named
    ``found`` is replaced). A
    benchmark beyond ``block_bytes`` is searched for block by block and the
    finds are joined by a hash of the text.
    """
    spark, docs = docs.sparkSession, in_small_batches(docs)
    blocks = _blocks(benchmark, block_bytes)
    items, following = next(blocks), next(blocks, None)
    if following is None:
        return docs.withColumn("found", _searcher(spark, Benchmark(items, window))(F.col("text")))
    text = F.coalesce("text", F.lit(""))
    keyed = F.concat(F.sha2(text, 256), F.length(text).cast("string"))
    found = counted = None
    while items is not None:
        one = docs.select(keyed.alias("_key"), _searcher(spark, Benchmark(items, window))("text").alias("f"))
        if counted is None:
            one = store(one, "first-block")
            counted = one.groupBy("_key").agg(F.max("f.n_words").alias("_n"))
        hit = store(one.where(F.size("f.hits") > 0).dropDuplicates(["_key"]).select("_key", "f"), "block")
        found = hit if found is None else found.unionByName(hit)
        items, following = following, next(blocks, None)
    best = F.max_by("f.longest", F.struct(F.col("f.longest.length"), -F.col("f.longest.start")))
    whole = found.groupBy("_key").agg(
        F.flatten(F.collect_list("f.hits")).alias("hits"), F.flatten(F.collect_list("f.items")).alias("items"),
        best.alias("longest"))
    kind = [f.dataType for f in hit.schema if f.name == "f"][0]
    none = F.array()
    finds = store(counted.join(whole, "_key", "left").select("_key", F.struct(
        F.col("_n").alias("n_words"), F.coalesce("hits", none.cast(kind["hits"].dataType)).alias("hits"),
        F.array_sort(F.array_distinct(F.coalesce("items", none.cast("array<string>")))).alias("items"),
        "longest").cast(kind).alias("found")), "finds")
    return docs.withColumn("_key", keyed).join(broadcast_if_small(finds), "_key").drop("_key")


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest) of every
    row; ``longest`` is the number of words of its longest verbatim match, or 0."""
    found = search(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    return found.select(
        "doc_id", "found.n_words", _summed(F.col("found.hits")).alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.size("found.hits") > 0).alias("contaminated"),
        F.coalesce("found.longest.length", F.lit(0).cast("long")).alias("longest"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, columns as they were."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return search(rows, benchmark, window, block_bytes).where(F.size("found.hits") == 0).select("row.*")
