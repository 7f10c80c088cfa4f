"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Patterns of form find seed entities. The words in front of seeds become
lexical patterns; patterns and the identifier-like tokens that they precede
form a graph, on which Spark scores both in rounds: a pattern is as good as
the share of its occurrences that precede known entities, a token as good as
the best patterns in front of it. Tokens in front of which high-confidence
patterns stand become entities, whatever their form.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import broadcast_if_small, store
from .host_rules import _bind

#: kinds in the order of the contract, and the forms of seeds. Every class is
#: followed by something outside it, so possessive runs that start where no
#: run is under way (or where the last match ended) find what the plain
#: patterns find, in time proportional to the text; fixed values
KINDS = ["email", "ip", "card", "phone"]
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: groups of digits with single spaces, dots, hyphens or brackets between them; or
#: a run of word characters with a digit or an @ sign
TOKEN = (r"(?<![A-Za-z0-9@._%+-])\(?[0-9]{1,4}+\)?(?:[\x20.-]?\(?(?<![0-9])[0-9]{1,4}+\)?)++(?![A-Za-z0-9@_%+])"
         r"|(?<![A-Za-z0-9@._%+-])[A-Za-z._%+-]*+[0-9@][A-Za-z0-9@._%+-]*+")
#: distinct seeds that make a pattern, least confidence of a pattern, rounds, digits of a token without @
SUPPORT, CONFIDENCE, ROUNDS, DIGITS = 3, 0.8, 3, 4
#: code points in front of an entity that its context is taken from; a context that would begin before them is none
REACH = 80

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _sums(values: Column) -> Column:
    """Running sums of an array, by blocks of about its root: n to the power 1.5 at most."""

    def over(a):
        def blocks(size):
            def at(sums):
                return F.transform(a, lambda x, i: F.aggregate(
                    F.slice(sums, F.lit(1), F.floor(i / size).cast("int")), F.lit(0), lambda p, q: p + q)
                    + F.aggregate(F.slice(a, (F.floor(i / size) * size).cast("int") + 1, (i % size).cast("int") + 1),
                                  F.lit(0), lambda p, q: p + q))
            return _bind(F.transform(
                F.sequence(F.lit(0), F.size(a) - 1, size),
                lambda s: F.aggregate(F.slice(a, s + 1, size), F.lit(0), lambda p, q: p + q)), at)
        return _bind(F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int"), blocks)

    return _bind(values, over)


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches as (start, kind, end, value) in code points, leftmost first, not overlapping."""

    def located(hits):
        def between(gaps):
            steps = F.transform(hits, lambda h, i: F.length(F.get(gaps, i)) + F.when(
                i > 0, F.length(F.get(hits, i - 1))).otherwise(0))
            return _bind(_sums(steps), lambda starts: F.transform(hits, lambda h, i: F.struct(
                F.get(starts, i).alias("start"), F.lit(kind).alias("kind"),
                (F.get(starts, i) + F.length(h)).alias("end"), h.alias("value"))))
        return F.when(F.size(hits) > 0, _bind(F.split(text, pattern, -1), between)).otherwise(
            F.array().cast(SPAN))

    return _bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
#: cheap tests that a text must pass before its matches are located
FIRST = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}


def seeds(text: Column) -> Column:
    """The entities found by form, by start, then kind."""
    none = F.array().cast(SPAN)

    def of(kind):
        return F.when(FIRST[kind](text), F.filter(
            matches(text, FORMS[kind], KINDS.index(kind)), lambda s: VALID[kind](s.value))).otherwise(none)

    found = [of(kind) for kind in KINDS]
    return F.when(text.rlike("[0-9@]"), F.array_sort(reduce(F.concat, found))).otherwise(none)


def tokens(text: Column, taken: Column) -> Column:
    """Identifier-like tokens that don't overlap ``taken`` (sorted spans)."""

    def like(s):
        return F.contains(s.value, F.lit("@")) | (F.length(_digits(s.value)) >= DIGITS)

    def free(s):
        return ~F.exists(taken, lambda o: (o.start < s.end) & (s.start < o.end))

    return F.when(text.rlike("[0-9@]"), F.filter(matches(text, TOKEN, -1), lambda s: like(s) & free(s))).otherwise(
        F.array().cast(SPAN))


def context(text: Column, start: Column) -> Column:
    """What stands in front of a span: the label attached to it (a:...) or the
    two words before it (b:...), in lower case; null where there is neither, or
    where it is longer than ``REACH`` less one."""
    before = F.lower(F.substring(text, F.greatest(start - REACH + 1, F.lit(1)), F.least(start, F.lit(REACH))))
    attached = F.regexp_extract(before, r"([^\x20\x09-\x0D]{2,})$", 1)
    two = F.regexp_extract(before, r"([^\x20\x09-\x0D]+)\x20([^\x20\x09-\x0D]+)\x20$", 0)

    def whole(found):
        return (F.length(found) < REACH) & found.rlike(r"\p{L}")

    return F.when(whole(attached), F.concat(F.lit("a:"), attached)).when(
        whole(two), F.concat(F.lit("b:"), F.rtrim(two)))


def uses(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(context, uses) of every ``wanted`` context: how often the texts hold it in front
    of anything, by the rule of ``context``. Two words, each of no white space, with a
    single space between and behind them; or a proper beginning of a word."""
    text, blank = F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]"
    two, label = (wanted.where(F.startswith("context", F.lit(k))) for k in ("b:", "a:"))

    def pair(w, x, i):
        first = F.regexp_extract(F.get(w, i - 1), r"([^\x20\x09-\x0D]+)$", 1)
        inner = (i > 0) & (i < F.size(w) - 1) & (x != "") & ~x.rlike(blank)
        return F.when(inner & (first != ""), F.concat(F.lit("b:"), first, F.lit(" "), x))

    found = docs.select(F.explode(_bind(F.split(text, r"\x20"), lambda w: F.transform(
        w, lambda x, i: pair(w, x, i)))).alias("context"))
    found = found.join(broadcast_if_small(two), "context", "left_semi")
    sizes = [r[0] for r in label.select(F.length("context") - 2).distinct().collect()]  # fewer than REACH
    if sizes:
        words = docs.select(F.explode(F.split(text, blank)).alias("w"))
        begun = words.select(F.explode(F.array(*[F.when(
            F.length("w") > n, F.concat(F.lit("a:"), F.substring("w", 1, n))) for n in sizes])).alias("context"))
        found = found.unionByName(begun.join(broadcast_if_small(label), "context", "left_semi"))
    return found.groupBy("context").agg(F.count(F.lit(1)).alias("uses"))


def _with_context(text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"), s.value.alias("value"),
        context(text, s.start).alias("context")))


def learn_patterns(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(context, kind, confidence) of the patterns that may discover entities.

    ``found`` has the seeds and tokens of every document with their contexts,
    ``docs`` the texts, in which all occurrences of contexts are counted,
    whatever follows them. Scores are sums over the whole corpus.
    """
    mentions = (
        found.select(F.explode(F.concat("seeds", "tokens")).alias("m")).select("m.kind", "m.value", "m.context")
        .where("context is not null")
        .groupBy("context", "kind", "value").agg(F.count(F.lit(1)).alias("n")))
    mentions = store(mentions, "mentions")
    # entities of another kind can't count for a pattern, so a context that they hold a fifth of can't be confident
    held = mentions.groupBy("context").agg(
        F.sum("n").alias("mentions"), F.sum(F.when(F.col("kind") < 0, F.col("n")).otherwise(0)).alias("open"))
    induced = store(
        mentions.where("kind >= 0").groupBy("context", "kind").agg(
            F.count(F.lit(1)).alias("support"), F.sum("n").alias("own"))
        .where(F.col("support") >= SUPPORT).join(held, "context")
        .where(F.col("own") + F.col("open") >= CONFIDENCE * F.col("mentions")), "induced")
    if induced.isEmpty():
        return induced.select("context", "kind", F.lit(0.0).alias("confidence"))

    counted = uses(docs, store(induced.select("context").distinct(), "contexts"))
    totals = store(
        induced.select("context", "mentions").distinct().join(counted, "context", "left")
        .select("context", F.greatest("mentions", F.coalesce("uses", F.lit(0))).alias("total")), "totals")

    # the graph: patterns of each kind, and the values that they precede
    edges = store(
        mentions.withColumnRenamed("kind", "own").join(induced.select("context", "kind"), "context")
        .where((F.col("own") == F.col("kind")) | (F.col("own") < 0))
        .select("context", "kind", "value", "n", (F.col("own") == F.col("kind")).alias("seed")), "graph")
    scores = None
    for _ in range(ROUNDS):
        weighed = edges.withColumn("score", F.col("seed").cast("double"))
        if scores is not None:
            weighed = edges.join(scores, ["kind", "value"], "left").withColumn(
                "score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("known", F.lit(0.0))))
        patterns = (
            weighed.groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("good"))
            .join(totals, "context").select("context", "kind", (F.col("good") / (F.col("total") + 1)).alias("confidence")))
        patterns = store(patterns, "patterns")
        # a token is as likely an entity as not all of its good patterns are wrong
        scores = store(
            edges.where("not seed").join(patterns.where(F.col("confidence") >= CONFIDENCE / 2), ["context", "kind"])
            .groupBy("kind", "value").agg((1 - F.product(1 - F.col("confidence"))).alias("known")), "scores")
    return patterns.where(F.col("confidence") >= CONFIDENCE)


def _search(docs: DataFrame, text: Column, keep: str) -> DataFrame:
    """(keep, seeds, spans) of every row by the whole ``text``."""
    whole = F.coalesce(text, F.lit(""))
    found = docs.withColumn("seeds", seeds(whole)).withColumn("tokens", tokens(whole, F.col("seeds")))
    found = store(found.select(
        keep, F.monotonically_increasing_id().alias("line"), _with_context(whole, F.col("seeds")).alias("seeds"),
        _with_context(whole, F.col("tokens")).alias("tokens")), "found")
    patterns = learn_patterns(found, docs.select(text.alias("text")))
    best = patterns.groupBy("context").agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), "kind")).alias("b")).select("context", "b.kind")
    new = (
        found.where(F.size("tokens") > 0).select("line", F.explode("tokens").alias("t"))
        .select("line", "t.start", "t.end", "t.context").join(broadcast_if_small(best), "context")
        .groupBy("line").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new")))
    plain = F.transform("seeds", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    return (
        found.join(broadcast_if_small(new), "line", "left").withColumn("seeds", plain)
        .select(keep, "seeds", F.array_sort(F.concat(
            "seeds", F.coalesce("new", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, seeds, spans) of every row; spans are (start, kind, end) by start, then kind.

    ``seeds`` are the entities found by form, ``spans`` those and the ones that
    learned patterns discover. Positions are code points, ends exclusive. A
    null text is empty and holds nothing. Rows that repeat are searched each;
    no rows: no rows. A token that patterns of several kinds precede takes the
    kind of the surest, then the first in order. Other columns are ignored.
    """
    return _search(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text"), "doc_id")


def _redacted(text: Column, spans: Column) -> Column:
    """``text`` with every stretch of overlapping spans replaced by the kind of its first."""
    masks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def merge(done, s):
        last = F.element_at(done, -1)
        return F.when(F.size(done) == 0, F.array(s)).when(
            s.start < last.end,
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(
                last.start.alias("start"), last.kind.alias("kind"), F.greatest(last.end, s.end).alias("end"))))
        ).otherwise(F.concat(done, F.array(s)))

    def rebuilt(merged):
        def end_before(i):
            return F.when(i > 0, F.get(merged, i - 1).end).otherwise(0)

        parts = F.transform(merged, lambda s, i: F.concat(
            F.substring(text, end_before(i) + 1, s.start - end_before(i)), F.get(masks, s.kind)))
        return F.concat(F.array_join(parts, ""), F.substring(
            text, F.element_at(merged, -1).end + 1, F.length(text)))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(F.size(spans) > 0, _bind(F.aggregate(spans, empty, merge), rebuilt)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every found span masked as [EMAIL], [IP], [CARD] or [PHONE].

    ``length_col``, where there is one, follows a changed text. Texts without
    finds, null ones too, stay as they are; so do all other columns.
    """
    text = F.col(f"row.`{text_col}`")
    found = _search(docs.select(F.struct(*docs.columns).alias("row")), text, "row")
    changed = found.withColumn("masked", _redacted(text, F.col("spans")))

    def column(c):
        old = F.col(f"row.`{c}`")
        if c == text_col:
            return F.col("masked").alias(c)
        if c == length_col:
            return F.when(F.size("spans") > 0, F.length("masked").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return changed.select(*map(column, docs.columns))


def written(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(
        F.get(names, s.kind), F.lit(":"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find``'s rows."""

    def count(kind):
        return F.size(F.filter("seeds", lambda s: s.kind == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(written(F.col("seeds")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"))
