"""Language spans of mixed-language text: script ranges narrow the candidates of
every word, character n-grams score it, and Viterbi with a switching penalty
labels the words of a whole text.

The model is counted by Spark on a bounded sample (about ``sample`` documents of
each language, whole texts); prediction reads the text alone.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, frugal, in_small_batches, map_documents

#: documents of each language, about, that the n-grams are counted on; hash buckets of n-grams
SAMPLE, BUCKETS = 2000, 1 << 15
#: cost of a change of language, and the most one word can say for one, in nats
SWITCH, WORD_CAP = 8.0, 6.0
#: characters handled at once
CHUNK = 1 << 20

#: first code point of stretches of the Unicode table, and their script; fixed values
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"),
    (0x1F00, "greek"), (0x2000, "latin"), (0x2C00, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xAB30, "latin"), (0xAB70, "other"), (0xAC00, "hangul"), (0xD7FC, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFEFF, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})

_TABLES = []


def _tables():
    """Lower case, letter or not, and script of every code point; once for each worker."""
    if not _TABLES:
        lower, letter = np.arange(0x110000, dtype="uint32"), np.zeros(0x110000, bool)
        for c in range(0x110000):
            char = chr(c)
            if char.isalpha():
                letter[c] = True
                low = char.lower()
                if len(low) == 1:
                    lower[c] = ord(low)
        starts = np.array([a for a, _ in SCRIPTS])
        names = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS], "int8")
        script = names[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]
        _TABLES.extend((lower, letter, script))
    return _TABLES


def _words(text: str):
    """Words of a text as (start, end, script, n-gram buckets of every letter).

    A word is a run of letters of one script."""
    lower, letter, script = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32")
    is_letter = letter[codes]
    at = np.nonzero(is_letter)[0]
    if not len(at):
        return None
    kind = script[codes[at]]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(kind) != 0)
    first = np.nonzero(new)[0]
    low = lower[codes[at]].astype("uint64")
    before, after = np.roll(low, 1), np.roll(low, -1)
    before[new] = 0
    after[np.roll(new, -1)] = 0
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    a, b, c, d = (np.uint64(x) for x in (
        0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
    one = low * b
    two = before * a + one + d
    three = two + after * c + d
    grams = np.stack([(x ^ (x >> np.uint64(29))) * a >> shift for x in (one, two, three)]).astype("int32")
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] + 1, kind[first], first, grams


def _pieces(text: str):
    """The text in stretches of about ``CHUNK`` characters that end between words."""
    start = 0
    while len(text) - start > CHUNK:
        end = start + CHUNK
        while end < len(text) and text[end].isalpha():
            end += 1
        yield start, text[start:end]
        start = end
    yield start, text[start:]


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every row of ``scores`` (words x languages) when each change costs ``switch``.

    If no stretch of another label gains more than half a switch over the best
    single label, that label is the answer (each excursion pays a switch at
    least); otherwise the full recursion runs. Ties keep the smaller label.
    """
    n, k = scores.shape
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, [best]], axis=0, dtype="float64")
    floor = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    if k == 1 or (gain - floor).max() <= switch / 2:
        return np.full(n, best)
    value, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        lead = value.index(top)
        bound = top - switch
        back.append([j if v >= bound else lead for j, v in enumerate(value)])
        value = [(v if v >= bound else bound) + s for v, s in zip(value, row)]
    path = [value.index(max(value))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1])


class Model:
    """Languages, weights of n-gram buckets, and languages that use each script."""

    def __init__(self, languages, grams, scripts):
        self.languages = languages
        # the three orders of n-grams overlap, so each counts for a third
        p = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)) / 3
        self.weights = np.ascontiguousarray((p - p.mean(axis=0) if len(p) else p).T.astype("float32"))
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.uses = (share >= 0.01).T

    def score_words(self, text):
        """(starts, ends, scores) of all words of a text."""
        parts = []
        for shift, piece in _pieces(text):
            found = _words(piece)
            if found is None:
                continue
            start, end, kind, first, grams = found
            letters = self.weights[grams[0]] + self.weights[grams[1]] + self.weights[grams[2]]
            scores = np.add.reduceat(letters, first, axis=0)
            scores -= scores.max(axis=1, keepdims=True)
            np.maximum(scores, -WORD_CAP, out=scores)
            uses = self.uses[kind]
            known = uses.any(axis=1)
            scores[~known] = 0
            scores[known[:, None] & ~uses] = -4 * WORD_CAP
            parts.append((start + shift, end + shift, scores))
        return [np.concatenate(x) for x in zip(*parts)] if parts else None

    def label(self, text):
        """(language, share of letters, spans) of a text; spans are (language, start, end) in code points."""
        found = self.score_words(text) if text and self.languages else None
        if found is None:
            return "und", 0.0, []
        start, end, scores = found
        path = viterbi(scores)
        letters = np.bincount(path, weights=end - start, minlength=len(self.languages))
        best = int(letters.argmax())
        cuts = np.append(np.nonzero(np.diff(path, prepend=-1))[0], len(path))
        spans = [(self.languages[path[a]], int(start[a]), int(end[b - 1])) for a, b in zip(cuts, cuts[1:])]
        return self.languages[best], float(letters[best] / letters.sum()), spans


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts n-grams and scripts of a sample of labelled documents.

    ``docs`` has doc_id, text and lang; rows without a lang don't count. A
    document is in the sample if the hash of its id falls below its language's
    share, which makes about ``sample`` documents of each language and all of a
    smaller one. What reaches the driver is languages x buckets numbers.
    """
    known = docs.where("lang is not null and text is not null")
    shares = known.groupBy("lang").count().select("lang", (F.lit(sample) / F.col("count")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(frames):
        totals = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                total = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), "int64"))
                for _, piece in _pieces(text):
                    found = _words(piece)
                    if found is not None:
                        start, end, kind, _, grams = found
                        total[:BUCKETS] += np.bincount(grams.ravel(), minlength=BUCKETS)
                        total[BUCKETS:] += np.bincount(
                            kind, weights=end - start, minlength=len(SCRIPT_NAMES)).astype("int64")
        for lang, total in totals.items():
            some = np.nonzero(total)[0]
            yield pd.DataFrame({"lang": lang, "bucket": some, "n": total[some]})

    counted = (
        in_small_batches(known.select("doc_id", "lang", "text")).join(broadcast_if_small(shares), "lang")
        .where(place < F.col("share")).select("lang", "text").mapInPandas(frugal(count), "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(counted["lang"].unique())
    table = np.zeros((len(languages), BUCKETS + len(SCRIPT_NAMES)))
    table[counted["lang"].map(languages.index).to_numpy(int), counted["bucket"].to_numpy()] = counted["n"]
    return Model(languages, table[:, :BUCKETS], table[:, BUCKETS:])


def label_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; ``score`` is the share of letters labelled lang_pred.

    A null text or one without a letter is ``und`` with score 0 and no spans,
    and so is every text if nothing was learned. Repeated rows are labelled
    each; extra columns are ignored; no rows: no rows. A tie between languages
    goes to the smaller name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(frames):
        for frame in frames:
            rows = [(doc, *sent.value.label(text)) for doc, text in zip(frame["doc_id"], frame["text"])]
            yield pd.DataFrame(rows, columns=["doc_id", "lang_pred", "score", "spans"])

    return map_documents(
        docs.select("doc_id", "text"), label, "lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>")
