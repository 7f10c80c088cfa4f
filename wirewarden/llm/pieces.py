"""Encoding and decoding with a SentencePiece vocabulary by shared-prefix Viterbi.

A text is cut into marked words (a run of marks and what follows up to the
next mark; no piece crosses such a border). The distinct words of a batch are
sorted, which makes neighbours share the path of a trie from its root, and are
walked depth first: the forward state of every position is kept for the prefix
that the next word shares with the last one.

In a unigram vocabulary the forward state is the best score of the prefix. In
a BPE vocabulary scores rank merges and don't add up, so the state is the last
piece of the prefix's encoding: the one piece that ends there and can follow
the state before it, a pair being valid if merging the two pieces' text gives
just these two. Backtracking is the same in both.
"""

import heapq
import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import map_documents

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: words and pairs remembered by a worker, and the longest of the words
REMEMBERED, PAIRS, LONGEST = 400_000, 1_000_000, 64


class Vocabulary:
    """Pieces of a model file: merges (BPE) or scores (unigram), byte pieces for what it lacks."""

    def __init__(self, pieces, scores, byte_ids, unigram=False, unknown=0):
        self.scores = {p: s for p, s in zip(pieces, scores) if p is not None}
        self.ids = {p: i for i, p in enumerate(pieces) if p is not None}
        self.texts = list(pieces)
        self.byte_ids, self.bytes = byte_ids, {i: b for b, i in enumerate(byte_ids)}
        self.unigram, self.unknown = unigram, unknown
        self._pairs, self._words = {}, {}

    @classmethod
    def load(cls, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
                 for i in range(n)]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([model.id_to_piece(i) if plain[i] else None for i in range(n)],
                   [model.get_score(i) for i in range(n)], byte_ids, unknown=model.unk_id())

    def merge(self, text: str):
        """BPE by its definition: the best-scored pair of neighbours first, the leftmost of equals."""
        parts, score = list(text), self.scores
        nxt, prev = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(i):
            j = nxt[i] if i >= 0 else len(parts)
            if i >= 0 and j < len(parts) and (s := score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or parts[i] + parts[j] != both or nxt[i] != j:
                continue
            parts[i], parts[j] = both, None
            nxt[i] = nxt[j]
            if nxt[i] < len(parts):
                prev[nxt[i]] = i
            offer(prev[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two pieces' text is these two (left may be 0: nothing)."""
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        both = [self.texts[left], self.texts[right]] if left else [self.texts[right]]
        found = self._pairs[left << 24 | right] = self.merge("".join(both)) == both
        return found

    def _load_suffixes(self):
        """Aho-Corasick automaton of the pieces: for every state, its edges and
        the (length, id) of the pieces that end there, longest first."""
        edges, fails, ends = [{}], [0], [()]
        for piece, i in self.ids.items():
            at = 0
            for char in piece:
                if char not in edges[at]:
                    edges[at][char] = len(edges)
                    edges.append({})
                    fails.append(0)
                    ends.append(())
                at = edges[at][char]
            ends[at] = ((len(piece), i),)
        level = list(edges[0].values())
        while level:
            following = []
            for at in level:
                for char, to in edges[at].items():
                    back = fails[at]
                    while back and char not in edges[back]:
                        back = fails[back]
                    fails[to] = edges[back].get(char, 0)
                    ends[to] += ends[fails[to]]
                    following.append(to)
            level = following
        self._edges, self._fails, self._ends = edges, fails, ends

    def _next(self, at, char):
        """The state after ``char``; edges found over shorter suffixes are remembered."""
        edges, fails, back = self._edges, self._fails, at
        while back and char not in edges[back]:
            back = fails[back]
        to = edges[back].get(char, 0)
        if to:
            edges[at][char] = to
        return to

    def walk(self, words):
        """Yields (word, ids) of sorted distinct words, sharing the states of common prefixes.

        At every position: state of the automaton, last piece (0: none, or a
        character that the vocabulary lacks) and its length, score."""
        if not hasattr(self, "_edges"):
            self._load_suffixes()
        edges, ends, pairs, texts, unigram = self._edges, self._ends, self._pairs, self.texts, self.unigram
        nodes, pieces, lengths, scores, last = [0], [0], [0], [0.0], ""
        for word in words:
            common = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                common += 1
            del nodes[common + 1:], pieces[common + 1:], lengths[common + 1:], scores[common + 1:]
            node = nodes[common]
            for end in range(common + 1, len(word) + 1):
                char = word[end - 1]
                node = edges[node].get(char) or self._next(node, char)
                # what the vocabulary lacks is spelled in bytes, at a price no piece has
                piece, length, score = 0, 1, scores[end - 1] - 1e6 if unigram else 0.0
                for size, candidate in ends[node]:
                    if unigram:
                        total = scores[end - size] + self.scores[texts[candidate]]
                        if total > score:
                            piece, length, score = candidate, size, total
                        continue
                    left = pieces[end - size]
                    fits = pairs.get(left << 24 | candidate)
                    if fits is None:
                        fits = self._fits(left, candidate)
                    if fits:
                        piece, length = candidate, size
                        break
                nodes.append(node)
                pieces.append(piece)
                lengths.append(length)
                scores.append(score)
            last, out, end = word, [], len(word)
            while end:
                start = end - lengths[end]
                if pieces[end]:
                    out.append(pieces[end])
                else:
                    out.extend(self.byte_ids[b] for b in reversed(word[start:end].encode("utf-8", "surrogatepass")))
                end = start
            yield word, tuple(reversed(out))

    def encode_batch(self, texts):
        """Ids of every text; a null or empty text has none."""
        cut = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self._words
        if len(known) >= REMEMBERED:
            known.clear()
        new = sorted(set(chain.from_iterable(cut)).difference(known))
        known.update(self.walk(new))
        out = [list(chain.from_iterable(map(known.__getitem__, words))) for words in cut]
        for word in new:
            if len(word) > LONGEST:
                del known[word]
        return out

    def decode(self, ids):
        """The text of ids: bytes are put together as UTF-8, marks become spaces, the first goes."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.texts[i] or "")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_LOADED = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each worker and file."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary.load(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; a null or empty text has no ids. Repeated rows
    are encoded each, extra columns ignored, no rows give no rows."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": vocabulary(path).encode_batch(frame[text_col])})

    return map_documents(docs.select("doc_id", text_col), run, "ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids); null or no ids give an empty text."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": [
                vocabulary(path).decode(ids if ids is not None else []) for ids in frame["ids"]]})

    return map_documents(encoded.select("doc_id", "ids"), run, "text string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, exact) of every row: the ids' checksum (little-endian
    unsigned 32-bit) and whether decoding gives the text back, marks in it as spaces."""

    def run(frames):
        for frame in frames:
            vocab = vocabulary(path)
            rows = []
            for doc, text, ids in zip(frame["doc_id"], frame["text"], vocab.encode_batch(frame["text"])):
                crc = zlib.crc32(np.array(ids, "<u4").tobytes())
                rows.append((doc, len(ids), crc, vocab.decode(ids) == (text or "").replace(MARK, " ")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids_crc32", "exact"])

    return map_documents(docs.select("doc_id", "text"), run, "n_ids long, ids_crc32 long, exact boolean")
