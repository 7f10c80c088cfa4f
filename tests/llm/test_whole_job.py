"""Cases in which an operator once did less than its whole job."""

import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from wirewarden.llm import common, host_rules, jaccard, packing, pii, toxicity
from wirewarden.llm.queries import tokenizer

from test_operators import SCHEMA, by_id, odd_texts, plain_components, plain_sets, sentence


def contained_pairs(n=60):
    """Isolated pairs of which one text is the other and more: Jaccard from 0.75 to 0.9, unequal sizes."""
    r, rows = random.Random(12), []
    for i in range(n):
        common = r.randrange(30, 120)
        more = round(common / r.uniform(0.75, 0.9)) - common
        words = [f"p{i}w{k}" for k in range(common + 4 + more)]
        short, long = words[:common + 4], words
        if i % 3 == 1:
            short = words[more:]
        rows += [(2 * i + i % 2, " ".join(short)), (2 * i + 1 - i % 2, " ".join(long))]
    return rows


@pytest.mark.parametrize("frequent", [3, 2])
def test_jaccard_links_contained_sets_of_unequal_size(spark, monkeypatch, frequent):
    """From 2 documents on a shingle is frequent: then the shared ones go last and each text's own come first."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = contained_pairs()
    want = plain_components(plain_sets(rows))
    got = by_id(jaccard.components_by_shingles(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < 80


# packing

RANKS = "byte_bpe_50k.tiktoken"


def contract():
    """The contract's encoder with its default settings."""
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


def test_added_tokens_in_a_text_are_one_id(spark):
    tok, end = contract(), "<|endoftext|>"
    around = [f"{a}{end}{b}" for a in ("", "a", "a ", "a  ", "a\n", "\u3000 ", end, "<|", "don'") for b in ("", "b", " b", "  b", "s", "|>", "\n\n")]
    texts = ["a <|endoftext|> b", *around, end * 300, "<|endoftext|", "<|ENDOFTEXT|>", "<|endoftext |>", end[:5] + end + end[5:]]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    assert [packing.encode(t, tokenizer(RANKS)) for t in texts] == want
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer(RANKS))
    crcs = {i: zlib.crc32(np.array([*ids, 2], "<u4").tobytes()) for i, ids in enumerate(want)}
    assert {r.doc_id: r.ids_crc32 for r in got.collect()} == crcs


def test_every_character_encodes_as_the_contract_says():
    texts = [f"a{chr(c)}a {chr(c)}{chr(c)}1  {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    own = packing.byte_bpe(tokenizer(RANKS)).encode_ordinary_batch(texts)
    assert own == [e.ids for e in contract().encode_batch_fast(texts, add_special_tokens=False)]


def test_long_runs_of_white_space():
    run, end = 1_100_000, "<|endoftext|>"
    texts = ["a" + " " * run + "b", "\n" * run, f"a{end}" + "\u3000" * run + end,
             *("a" + c * packing.RUN + tail for c in " \t\x85" for tail in ("", "b", "\n1"))]
    short = ["a" + " " * (packing.RUN - 1) + "b", "a" + " \n" * 40_000]
    assert all(map(packing.LONG_RUN.search, texts)) and not any(map(packing.LONG_RUN.search, short))
    tok = contract()
    for text in texts + short:
        assert packing.encode(text, tokenizer(RANKS)) == tok.encode(text, add_special_tokens=False).ids
    assert len(packing.encode(texts[0], tokenizer(RANKS))) == run + 1


# near duplicates where ids don't tell rows apart

def test_one_row_of_each_component_whatever_the_ids_are(spark):
    copy, near, other = sentence(60), None, sentence(50)
    near = copy + " end"
    rows = [(1, copy), (1, copy), (2, near), (None, copy), (None, other), (None, other), (3, "alone here"), (3, "alone here"),
            (4, ""), (4, ""), (None, None), (None, ""), (5, sentence(40)), (5, sentence(41)), (6, other + " more")]
    docs = spark.createDataFrame([(i, t, None, None, None, "c", n, 0, 0) for n, (i, t) in enumerate(rows)], SCHEMA)
    kept = jaccard.drop_duplicates(docs)
    assert kept.columns == docs.columns
    # of 1 and its copies one row; of other the one with an id; of 3, 4 and 5 one each; texts without words or id stay
    got = sorted((r.doc_id or 0, r.row) for r in kept.collect())
    assert got == [(0, 10), (0, 11), (1, 0), (3, 6), (4, 8), (5, 12), (6, 14)]
    unlinked = spark.createDataFrame([(None, copy), (None, near), (None, "x y")], "doc_id long, text string")
    assert sorted(r.text for r in jaccard.drop_duplicates(unlinked).collect()) in (sorted([copy, "x y"]), sorted([near, "x y"]))
    assert jaccard.drop_duplicates(docs.limit(0)).count() == 0


def test_ids_may_be_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 4)
    texts = [t for t in odd_texts() if t] + [sentence(80) + " tail"] * 2
    sets = plain_sets([(f"k{i:03}", t) for i, t in enumerate(texts)])
    docs = spark.createDataFrame([(f"k{i:03}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = by_id(jaccard.components_by_shingles(docs))
    assert {i: r.component_id for i, r in got.items()} == plain_components(sets)
    assert {r.doc_id for r in jaccard.drop_duplicates(docs).collect()} == set(plain_components(sets).values())


# toxicity of pairs alone

def test_words_that_matter_only_together_are_learned(spark):
    """Toxic exactly if both or neither of two words occur: neither has an effect of its own."""
    r = random.Random(8)
    rows, labels = [], []
    for i in range(8000):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(30)}x" for _ in range(12)] + ["martian"] * a + ["fool"] * b
        words = [w.translate(str.maketrans("0123456789", "jklmnpqrst")) for w in words]
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks, F.col("doc_id") % 4 != 2)
    got = by_id(toxicity.score_documents(docs.where("doc_id % 4 = 2"), model, 0.5))
    truth = dict(labels)
    assert np.mean([r.predicted == truth[i] for i, r in got.items()]) >= 0.95


# personal data behind learned contexts

def with_contexts():
    numbers = [f"+1 415 555 {i:04}" for i in range(2000, 2030)]
    texts = [f"please dial me {n} today" for n in numbers[:20]] + [f"tel:{n} x" for n in numbers[20:]]
    texts += ["please dial me 415 555 2671 now", "dial me 4111 1111 1111 1112.", "so dial me (415) 555-2672", "tel:5550199 or",
              "a dial me", "x\ndial me 5550123 y", "dial\tme 5550124", "dial me\n5550125", "you dial  me 5550126", "never 415 555 2671",
              "w" * 90 + " me 5550127", "tel:", "TEL:x", "Dial Me 5550128"]
    return texts


def test_spaced_identifiers_are_found_whole(spark):
    texts = with_contexts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.digest(pii.find(docs)))
    found = {i: [tuple(s.split(":")) for s in r.spans.split(",") if s] for i, r in got.items()}
    cut = {i: [texts[i][int(a):int(b)] for _, a, b in spans] for i, spans in found.items()}
    assert [cut[i] for i in range(30, 34)] == [["415 555 2671"], ["4111 1111 1111 1112"], ["(415) 555-2672"], ["5550199"]]
    assert cut[35] == ["5550123"] and cut[43] == ["5550128"] and not any(cut[i] for i in (34, 36, 37, 38, 39, 40, 41, 42))
    masked = by_id(pii.redact(docs))
    assert masked[30].text == "please dial me [PHONE] now" and masked[31].text == "dial me [PHONE]."
    assert all(r.n_phone == (i < 30) for i, r in got.items())


def test_contexts_are_counted_as_they_are_taken(spark):
    """Every use of a context in front of anything, by a plain reading of the texts."""
    import re
    texts = with_contexts() + odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    contexts = ["b:dial me", "b:call me", "b:w1 w2", "a:tel:", "a:+1", "b:please dial", "b:one line"]
    wanted = common.store(spark.createDataFrame([(c,) for c in contexts], "context string"), "wanted")
    got = {r.context: r.uses for r in pii.uses(docs, wanted).collect()}
    space = "\x20\x09-\x0D"
    for c in contexts:
        body = re.escape(c[2:])
        pattern = rf"(?<![^{space}])(?={body}\x20)" if c[0] == "b" else rf"(?<![^{space}])(?={body}[^{space}])"
        assert got.get(c, 0) == sum(len(re.findall(pattern, (t or "").lower())) for t in texts), c
    assert got["b:dial me"] > 20 and got["a:tel:"] >= 12


# hosts

def test_bad_hosts_take_their_passing_documents_with_them(spark):
    """Hosts that fail in 5 to 15 of 100 cases keep all that passes, hosts beyond one half lose it."""
    r = random.Random(1)
    rows, rates = [], {f"fair{i}": 0.05 + i / 100 for i in range(10)} | {"poor": 0.45, "bad": 0.7, "worse": 0.85}
    for host, rate in rates.items():
        for k in range(100):
            rows.append((len(rows), " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(10 if k < 100 * rate else 60)), host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = host_rules.judge(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    lost = {h: sum(not x.base_failed and not x.kept for x in judged if x.source == h) for h in rates}
    assert lost["bad"] == 30 and lost["worse"] == 15 and sum(lost.values()) == 45
    assert sum(x.base_failed for x in judged if x.source in ("bad", "worse")) == 155
    assert {x.doc_id for x in host_rules.keep_good(docs).collect()} == {x.doc_id for x in judged if x.kept}


# disk of the Jaccard join

def test_filter_of_shared_shingles_holds_them_all_and_few_others(spark):
    r = np.random.default_rng(5)
    own, common = r.integers(-2**63, 2**63 - 1, 40_000), r.integers(-2**63, 2**63 - 1, 500)
    rows = [(i, np.sort(np.concatenate([own[20 * i:20 * i + 20], r.choice(common, 5, replace=False)])).tolist(), [])
            for i in range(2000)]
    rows.append((2000, [], []))
    found = jaccard._shared_filter(spark.createDataFrame(rows, "sig long, rare array<long>, hot array<long>"))
    times = np.unique(np.concatenate([np.array(x[1], "int64") for x in rows]), return_counts=True)
    shared, alone = times[0][times[1] > 1], times[0][times[1] == 1]
    assert len(shared) > 400 and found.may_hold(shared).all()
    assert found.may_hold(alone).mean() < 0.05
    none = jaccard._shared_filter(spark.createDataFrame([(1, [3, 4], [])], "sig long, rare array<long>, hot array<long>"))
    assert not none.may_hold(np.array([3, 4, 5])).any()


@pytest.mark.parametrize("text", ["a b c d e f", "x" * 5000, "", "one line\n" * 400, "".join(chr(0x4E00 + i * 7 % 9000) for i in range(3000)),
                                  " ".join("".join(random.Random(i).choices("abcdefghijklmnop", k=30)) for i in range(200))])
def test_a_packed_text_has_the_same_shingles(text):
    data, size = jaccard._packed(text)
    assert (jaccard._unpacked(data, size) == jaccard.shingles(text)).all()
    assert len(data) <= max(40, len(text.encode()), 8 * len(jaccard.shingles(text)))


@pytest.mark.parametrize("waves", [8, 0])
def test_texts_stay_where_ids_are_beyond_a_broadcast(spark, monkeypatch, waves):
    """Components and kept rows are the same, the scratch tables of prefixes are gone, and no text is shuffled for a join with ids."""
    rows = contained_pairs()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(plain_sets(rows))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 200)
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 200)
    monkeypatch.setattr(common, "WAVES", waves if not waves else 1000)
    assert {i: r.component_id for i, r in by_id(jaccard.components_by_shingles(docs)).items()} == want
    kept = jaccard.drop_duplicates(docs)
    assert {r.doc_id for r in kept.collect()} == set(want.values())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert not waves or "SortMergeJoin" not in plan
    folder = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir() + "/prefixes-*")
    assert not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder)
