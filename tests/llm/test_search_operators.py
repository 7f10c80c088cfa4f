"""Decontamination, tokenizer alignment and hard negatives against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirewarden.llm import alignment, common, decontamination, negatives
from wirewarden.llm.queries import tokenizer

from test_operators import SCHEMA, by_id, odd_texts, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


# decontamination

def plain_finds(texts, items, window=10):
    out = []
    for text in texts:
        w, hit, names, longest = words(text), set(), set(), 0
        for name, item in items:
            v = words(item)
            need = min(window, len(v))
            for i in range(len(v) - need + 1 if v else 0):
                for p in range(len(w) - need + 1):
                    if w[p:p + need] == v[i:i + need]:
                        n = need
                        while p + n < len(w) and i + n < len(v) and w[p + n] == v[i + n]:
                            n += 1
                        hit.update(range(p, p + need))
                        longest = max(longest, n)
                        if name is not None:
                            names.add(str(name))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((len(w), len(hit), len(names), sha, bool(hit), longest))
    return out


def contaminated():
    r = random.Random(5)
    base = [sentence(n, r) for n in (60, 40, 25, 12, 10, 9, 3, 30)]
    items = [*enumerate(base), (20, base[0]), (21, base[1] + " and more " + base[2]), (None, sentence(15, r)), (22, None),
             (23, ""), (24, "#?! --"), (25, "zz " * 30), (26, "un mot"), (6, "quite another text for the same id, ok?"),
             (27, "x" * 700 + " " + " ".join(f"k{i}" for i in range(12)))]
    texts = odd_texts()[:40] + [
        base[0], base[0].upper(), "start " + base[0] + " end", base[1][20:], " ".join(words(base[2])[3:14]),
        " ".join(words(base[2])[:9]), base[3] + "\n" + base[3], base[5], "x " + base[6] + " y", items[10][1],
        "zz " * 500, "zz " * 9, "un, mot! UN MOT", sentence(300, r) + " " + base[7] + " " + sentence(300, r),
        (base[4] + " | ") * 40, items[-2][1], "x" * 700, items[-1][1], "x" * 699 + " " + items[-1][1][701:],
        base[0][:100] + " " + base[1][:100]]
    return texts, items


@pytest.mark.parametrize("block,shard", [(1 << 24, 1 << 22), (600, 1 << 22), (1 << 24, 2000)])
def test_decontamination(spark, monkeypatch, block, shard):
    monkeypatch.setattr(decontamination, "SHARD", shard)
    texts, items = contaminated()
    rows = [(i, t, None, None, i, "found", i, 0, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[-3:], SCHEMA).repartition(3)
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = decontamination.digest(docs, bench, block_bytes=block).collect()
    want = plain_finds(texts, items)
    assert len(got) == len(texts) + 3
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest) == want[r.doc_id], r.doc_id
    assert sum(w[4] for w in want) > 15 and any(w[5] > 40 for w in want)
    packed = docs.withColumn("found", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("row", F.lit(3))
    clean = decontamination.remove_contaminated(packed, bench, block_bytes=block)
    assert clean.columns == packed.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, w in enumerate(want) if not w[4]}


def test_decontamination_places(spark):
    base = [f"b{i}" for i in range(30)]
    docs = spark.createDataFrame(
        [(1, "x y " + " ".join(base[4:20]) + " z " + " ".join(base)), (2, None)], "doc_id long, text string")
    got = by_id(decontamination.search(docs, spark.createDataFrame([("i", " ".join(base))], "item_id string, text string")))
    assert [tuple(h) for h in got[1].found.hits] == [(2, 18), (19, 49)] and got[1].found["items"] == ["i"]
    assert tuple(got[1].found.longest) == (19, 30)
    assert tuple(got[2].found) == (0, [], [], None)


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.digest(docs, none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)] * 3
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.digest(docs.limit(0), one).count() == 0 == decontamination.remove_contaminated(docs, one).count()


def test_suffix_array_is_sorted():
    r = np.random.default_rng(3)
    for n, k, least in ((200, 3, 1), (300, 2, 4), (50, 1, 1), (400, 40, 2)):
        x = r.integers(0, k + 1, n + 1)
        x[-1] = 0
        at = decontamination.suffix_array(x, n, least)
        runs = [x[i:i + np.flatnonzero(x[i:] == 0)[0]].tolist() for i in range(n)]
        start = [i for i in range(n) if x[i] and (i == 0 or not x[i - 1])]
        want = [i for s in start if len(runs[s]) >= least for i in range(s, s + len(runs[s]))]
        assert sorted(at.tolist()) == want and at.tolist() == sorted(want, key=lambda i: (runs[i], i))


def test_words_are_hashed_alike_in_pieces(monkeypatch):
    texts = [t for t in odd_texts() if t] + ["é" * 400 + " " + "é" * 399, "a" * 256 + " " + "a" * 257 + " " + "a" * 256]
    whole = decontamination.joined(texts)
    assert np.bincount(whole[1], minlength=len(texts)).tolist() == [len(words(t)) for t in texts]
    known = {}
    for h, w in zip(whole[0].tolist(), [w for t in texts for w in words(t)]):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    monkeypatch.setattr(decontamination, "CHUNK", 100)
    assert all((a == b).all() for a, b in zip(whole, decontamination.joined(texts)))


# alignment

@pytest.fixture(scope="module")
def tools():
    return alignment.Aligner(tokenizer("byte_bpe_50k.tiktoken"), tokenizer("piece_bpe_32k.model"))


def strange_texts():
    return odd_texts() + [
        "a▁b c", "▁", " x", " \n  y  z ", "foo  ", "  ", "\x1c a \x1db", "<|endoftext|> <s> </s> <unk> <0x41>", "日本 語 です",
        "é ́ x", "a​ b", "\x00 \x00a", "aaaa" * 300, "﻿b", "ﬁ ½ Å"]


def plain_alignments(texts):
    import sentencepiece
    from tokenizers import Tokenizer, decoders
    a_tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    # the byte-level alphabet: printable bytes as they are, the others from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    found, counts = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = a_tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        a_raw = [bytes(of[c] for c in a_tok.id_to_token(i)) for i in a]
        b_raw = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()
                 for i, p in ((i, b_tok.id_to_piece(i)) for i in b)]
        if not text or b"".join(a_raw) != raw or b"".join(b_raw) != raw:
            found.append(None)
            continue
        ends = [dict() for _ in range(2)]
        for own, parts, ids in zip(ends, (a_raw, b_raw), (a, b)):
            at = 0
            for k, part in enumerate(parts):
                at += len(part)
                own[at] = k
        groups, links, i, j = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            x, y = ends[0][end], ends[1][end]
            groups.append(",".join(map(str, a[i:x + 1])) + "|" + ",".join(map(str, b[j:y + 1])))
            links.append((a[x], b[y]))
            i, j = x + 1, y + 1
        counts.update(links)
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, counts, found


def test_alignment(spark, monkeypatch):
    """Several blocks, repeated rows, rows without an id and extra columns."""
    texts = strange_texts()
    texts = texts + texts[:20]
    rows = [(i if i % 11 else None, t, None, None, i, "c", i, 0, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3, "row")
    paths = tokenizer("byte_bpe_50k.tiktoken"), tokenizer("piece_bpe_32k.model")
    got = alignment.align_documents(docs, *paths)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want, counts, found = plain_alignments(texts)
    assert sorted((r[0] or -1, *r[1:]) for r in map(tuple, got.collect())) == sorted(
        (i if i % 11 else -1, *w) for i, w in enumerate(want))
    assert want[texts.index("a▁b c")][0] == 0 and sum(w[0] > 0 for w in want) > 40
    blocks = common.store(alignment.pair_bitmaps(docs, *paths), "blocks")
    assert blocks.count() >= 3
    documents = Counter(p for f in found if f for p in set(f[3]))
    pairs = alignment.pair_counts(blocks).collect()
    assert {(r.a_id, r.b_id): (r.documents, r.links) for r in pairs} == {p: (documents[p], n) for p, n in counts.items()}
    assert alignment.align_documents(docs.limit(0), *paths).count() == 0


def test_very_long_runs_are_aligned(tools):
    run = 120_000
    a, b, at, bt = tools.align("a" + " " * run + "b")
    assert tools.a_size[a].sum() == tools.b_size[b].sum() == run + 3 and len(at) == len(bt) > 0


@pytest.mark.parametrize("n_docs", [1, 7, 8, 9, 700])
def test_bitmaps_hold_every_posting(n_docs):
    r = np.random.default_rng(n_docs)
    n_pairs = 60
    times = r.integers(0, 9, (n_pairs, n_docs)) * (r.random((n_pairs, n_docs)) < r.random((n_pairs, 1)))
    times[:, 0] += 1
    times[5] = 1000
    pair, doc = np.nonzero(times)
    planes = alignment.planes_of(pair, doc, times[pair, doc], n_pairs, n_docs)
    back = np.zeros_like(times)
    for k, plane in enumerate(planes):
        p, d = alignment.entries(plane, n_docs)
        back[p, d] += 1 << k
    assert (back == times).all()
    documents, links = alignment.counted(planes, n_pairs, n_docs)
    assert (documents == (times > 0).sum(axis=1)).all() and (links == times.sum(axis=1)).all()


# hard negatives

TOP = (1 << 63) - 1


def plain_negatives(rows, every=50, positives=5, negatives_=3):
    ok = {}
    for i, vector, label in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        if label is not None and all(x is not None and np.isfinite(x) for x in vector):
            ok.setdefault(i, ([int(np.floor(256 * float(x))) for x in vector], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (u, label) in ok.items():
        if a % every:
            continue
        score = {i: max(-TOP - 1, min(TOP, sum(x * y for x, y in zip(u, v)))) for i, (v, _) in ok.items() if i != a and len(v) == len(u)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if ok[i][1] == label][:positives]:
            hard = [i for i in order if ok[i][1] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, rank, n, score[p], score[n]) for rank, n in enumerate(hard[:negatives_], 1)]
    return sorted(out)


def some_vectors(n=700, width=20):
    r = np.random.default_rng(11)
    centres = r.normal(size=(10, width))
    rows = [(int(i), (centres[r.integers(10)] + r.normal(size=width)).tolist(), int(r.integers(10))) for i in range(n)]
    rows += [(1000 + i, np.round(r.normal(size=width)).tolist(), i % 4) for i in range(200)]  # ties
    rows += [(2000, None, 1), (2050, [float("nan")] * width, 1), (2100, [None] + [1.0] * (width - 1), 1), (2150, [1.0] * width, None),
             (None, [1.0] * width, 2), (2200, [1.0, 2.0], 3), (2201, [1.0, 2.0], 3), (2202, [1.0, 1.2], 4), (2250, [], 2),
             (2251, [], 2), (2252, [], 5), (2300, [0.0] * width, 0), (2350, [float("inf")] * width, 1), (-50, rows[3][1], 2),
             (2400, [1e15] * width, 6), (2401, [9e14] * width, 6), (2402, [7e14] * width, 7), (2450, [-1e-300] * width, 6)]
    return rows


@pytest.mark.parametrize("block,anchors,step", [(8192, 2048, 8), (100, 7, 3), (300, 64, 1)])
def test_hard_negatives(spark, monkeypatch, block, anchors, step):
    for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("STEP", step)):
        monkeypatch.setattr(negatives, name, value)
    rows = some_vectors()
    schema = "vec_id long, embedding array<double>, label int, id int, v string, rank int"
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows + rows[:60]], schema).repartition(3)
    got = sorted(map(tuple, negatives.hard_negatives(df).collect()))
    want = plain_negatives(rows)
    assert got == want and len(want) > 150 and any(w[4] == TOP for w in want)
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_the_scan_drops_candidates_early():
    """Candidates that the bounds exclude are not read to the last column."""
    r = np.random.default_rng(2)
    vectors = np.floor(256 * r.normal(size=(2000, 64)) * 0.85 ** np.arange(64))
    block = negatives.Block(np.arange(2000), np.zeros(2000, int), vectors, 1000.0)
    left = []
    found, score = block.scan(vectors[0], np.arange(1, 2000), lambda at, least, most: (
        left.append(len(at)), most >= negatives._kth(least, 5))[1])
    want = np.sort(vectors[1:] @ vectors[0])[-5:]
    assert sorted(score)[-5:] == want.tolist()
    assert left[0] == 1999 and left[3] < 1500 and left[-1] < 100, left


def test_windows_are_whole_scores():
    for p in range(-50, 400):
        inside = [s for s in range(-100, 500) if 50 * p <= 100 * s <= 95 * p]
        w = negatives.window(p)
        assert (w is None and not inside) or w == (inside[0], inside[-1])
