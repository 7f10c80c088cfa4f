"""Quality rules with host-level verdicts, in DataFrame functions only.

Rules are counted in every document; failures are summed by host; each host's
rate is shrunk towards a beta prior fitted to all hosts; documents of hosts
whose shrunk rate is too high go with the ones that fail themselves.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, store

SPACES = r"[\x20\x09-\x0D]+"


def _bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def words(text: Column) -> Column:
    """Runs of other characters than space, \\t, \\n, \\v, \\f and \\r."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(tokens: Column, window: int = 3) -> Column:
    """Words covered by windows that occur twice or more, first ones included.

    Windows are sorted as hash and position in one number, equal neighbours are
    compared word by word, and the covered stretches added up: n log n in the
    length of the document.
    """

    def count(w):
        n = F.size(w)
        # position in the low bits, as many as n needs; the hash in the rest
        bits = F.length(F.bin(n.cast("long"))).cast("int")
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def covered(low):
            def same(a, b):
                checks = [F.get(w, a.cast("int") + k) == F.get(w, b.cast("int") + k) for k in range(window)]
                out = checks[0]
                for c in checks[1:]:
                    out = out & c
                return out

            packed = F.sort_array(F.transform(
                F.sequence(F.lit(0), n - window),
                lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]).bitwiseAND(F.bitwise_not(low))
                .bitwiseOR(i.cast("long"))))

            def positions(s):
                def repeated(x, i):
                    before, after = F.get(s, i - 1), F.get(s, i + 1)
                    return (
                        (i > 0) & (x.bitwiseXOR(before).bitwiseAND(F.bitwise_not(low)) == 0)
                        & same(x.bitwiseAND(low), before.bitwiseAND(low))
                    ) | F.coalesce(
                        (x.bitwiseXOR(after).bitwiseAND(F.bitwise_not(low)) == 0)
                        & same(x.bitwiseAND(low), after.bitwiseAND(low)), F.lit(False))
                return F.sort_array(F.transform(F.filter(s, repeated), lambda x: x.bitwiseAND(low)))

            def stretch(p):
                return F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
                                   lambda acc, x: F.struct(
                                       (acc.n + x + window - F.greatest(acc.end, x)).alias("n"),
                                       (x + window).alias("end")), lambda acc: acc.n)

            return _bind(_bind(packed, positions), stretch)

        return F.when(n < window + 1, F.lit(0).cast("long")).otherwise(_bind(low, covered))

    return _bind(tokens, count)


def document_stats(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); a null text has none of them."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = _bind(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    return {
        "counts": counts,
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": _bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def fails_rules() -> Column:
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_stats(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """The ``keep`` columns with the five counts of ``text`` and base_failed."""
    s = document_stats(text)
    counted = docs.select(
        *keep, s["counts"].alias("c"), s["n_symbols"].alias("n_symbols"), s["n_dup_lines"].alias("n_dup_lines"))
    kept = counted.columns[:len(keep)]
    return counted.select(
        *kept, "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words").withColumn(
        "base_failed", fails_rules())


#: a host of which more than this share fails is rejected: at most one passing document goes with each failing one
WORST_RATE = 0.5


def host_verdicts(stats: DataFrame, worst_rate: float = WORST_RATE, least_docs: int = 20) -> DataFrame:
    """(host, docs, failed, shrunk_rate, host_kept) from rows of (host, base_failed).

    The prior is Beta(a, b) with the mean and variance of the hosts' rates
    (method of moments; one pseudo-document where the variance says nothing).
    A host is rejected when its shrunk rate exceeds ``worst_rate`` over at least
    ``least_docs`` documents: by then it loses fewer good documents than bad ones.
    """
    hosts = stats.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("docs")
    mean, var = hosts.agg(F.coalesce(F.avg(rate), F.lit(0.0)), F.coalesce(F.var_pop(rate), F.lit(0.0))).first()
    weight = mean * (1 - mean) / var - 1 if 0 < var < mean * (1 - mean) else 1.0
    shrunk = (F.col("failed") + mean * weight) / (F.col("docs") + weight)
    return hosts.select(
        "host", "docs", "failed", shrunk.alias("shrunk_rate"),
        (~((shrunk > worst_rate) & (F.col("docs") >= least_docs))).alias("host_kept"))


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept.

    A null or empty text has no words and fails. A null host has no verdict of
    its own: its documents stand by their own rules. Repeated rows are judged
    each. The host table has a row per host; its join splits skewed hosts at
    run time. An empty table gives no rows; extra columns are ignored.
    """
    stats = store(with_stats(
        docs, F.col(text_col), F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host")), "rules")
    verdicts = host_verdicts(stats).select("host", "host_kept")
    return stats.join(verdicts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, columns unchanged; texts are read once
    and not shuffled. Rows that repeat are judged each, a null text fails, a null
    host has no verdict; a host exactly at the threshold stays. No rows: no rows."""
    marked = store(with_stats(
        docs, F.col(text_col), F.struct(*docs.columns).alias("row"), F.col(host_col).cast("string").alias("host"))
        .select("row", "host", "base_failed"), "marked")
    bad = broadcast_if_small(host_verdicts(marked).where("not host_kept").select("host"))
    return marked.where("not base_failed").join(bad, "host", "left_anti").select("row.*")
