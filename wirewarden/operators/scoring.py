"""Log-likelihood of a sequence under a Gaussian hidden Markov model.

The forward recursion runs in log space as one native expression. Thresholds
and live scores come from this same expression, so the worst training sequence
ties exactly with its own threshold. ln and exp are bit-stable in the JVM: a
model trained on one machine alarms the same on another.

Letters and digits each collapse to one symbol, so a sequence is runs. A run of
n symbols is one step (a matrix of transition and emission) taken n times; the
step's powers 1, 2, 4... 64 are squared up once per model, and a run costs as
many products as n has binary digits, plus n // 64.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import symbol_states
from ..functions.symbols import DIGIT, LETTER

_NEVER = float("-inf")
# Powers of a step that a model carries: the step taken 1, 2, 4... 64 times, for
# models of up to MOST_STATES states (k * k numbers each); larger ones go symbol by symbol.
POWERS, MOST_STATES = 7, 8
# Cuts a sequence into stretches of these lengths, the longest first, and other symbols.
_STRETCH = "|".join(f"{c}{{{1 << b}}}" for c in (LETTER, DIGIT) for b in reversed(range(POWERS))) + f"|[^{LETTER}{DIGIT}]"


def _log(p: Column) -> Column:
    # ln(0) is null in Spark
    return F.when(p > 0, F.log(p)).otherwise(F.lit(_NEVER))


def with_score_parameters(models: DataFrame) -> DataFrame:
    """Add what scoring reads, once per model: ``lp`` log start, ``lt`` logs of
    the transitions by destination state, ``em`` emission terms, ``pw`` powers of
    the step of a letter, then of a digit."""
    states = F.sequence(F.lit(0), F.col("n_components") - 1)
    turned = F.transform(states, lambda j: F.transform("transmat", lambda row: F.element_at(row, j + 1)))
    terms = models.withColumns({
        "lp": F.transform("startprob", _log),
        "lt": F.transform(turned, lambda into: F.transform(into, _log)),
        "em": F.zip_with(
            "means", "vars",
            lambda m, v: _emission_terms(m, v),
        ),
    })
    few = F.col("n_components").between(2, MOST_STATES)
    return terms.withColumn("pw", F.when(few, F.concat(_powers("letter"), _powers("digit"))))


def _powers(symbol: str) -> Column:
    """Matrices by destination state, each the square of the one before."""
    once = F.zip_with("lt", "em", lambda into, e: F.transform(into, lambda t: t + e[symbol]))

    def squared(m):
        froms = F.sequence(F.lit(0), F.size(m) - 1)
        return F.transform(m, lambda into: F.transform(
            froms, lambda i: _log_sum(F.zip_with(into, F.transform(m, lambda row: F.get(row, i)), lambda a, b: a + b))))

    return F.aggregate(
        F.sequence(F.lit(2), F.lit(POWERS)), F.array(once),
        lambda found, _: F.concat(found, F.array(_let(F.element_at(found, -1), squared))))


def _emission_terms(mean: Column, variance: Column) -> Column:
    """Density terms of one state, and its value at the two frequent symbols."""
    norm, half = F.lit(-0.5) * F.log(F.lit(2 * math.pi) * variance), F.lit(0.5) / variance

    def at(symbol):
        dev = F.lit(float(ord(symbol))) - mean
        return norm - dev * dev * half

    return F.struct(
        mean.alias("mean"), norm.alias("norm"), half.alias("half"),
        at(DIGIT).alias("digit"), at(LETTER).alias("letter"),
    )


def _let(value: Column, body) -> Column:
    """Bind a value once inside a lambda: body(value) without repeating it."""
    return F.transform(F.array(value), body)[0]


def _emission(e: Column, x: Column) -> Column:
    rare = e["norm"] - (x - e["mean"]) * (x - e["mean"]) * e["half"]
    return (
        F.when(x == ord(DIGIT), e["digit"]).when(x == ord(LETTER), e["letter"]).otherwise(rare)
    )


def _log_sum(values: Column) -> Column:
    def shifted(v, m):
        total = F.aggregate(v, F.lit(0.0), lambda s, y: s + F.exp(y - m))
        return F.when(m == _NEVER, m).otherwise(m + F.log(total))

    return _let(values, lambda v: _let(F.array_max(v), lambda m: shifted(v, m)))


def _single_state(symbols: Column) -> Column:
    """One state leaves nothing to choose: the emissions add up, and equal
    symbols add up to a product, so only rare symbols are visited."""
    e = F.col("em")[0]
    n = F.length(symbols).cast("double")

    def far(x):
        return (x - e["mean"]) * (x - e["mean"])

    letters, digits = (F.length(symbols) - F.length(F.translate(symbols, c, "")) for c in (LETTER, DIGIT))
    others = F.aggregate(
        symbol_states(F.translate(symbols, LETTER + DIGIT, "")), F.lit(0.0), lambda s, x: s + far(x)
    )
    none_left = letters + digits == F.length(symbols)
    common = letters * far(F.lit(float(ord(LETTER)))) + digits * far(F.lit(float(ord(DIGIT))))
    return n * e["norm"] - e["half"] * (common + F.when(none_left, F.lit(0.0)).otherwise(others))


def _steps(symbols: Column) -> Column:
    """The steps behind the first symbol, stretch by stretch: a power's place in
    ``pw``, or -1 minus the code of a symbol that has none."""
    def of(stretch):
        power = F.bit_count(F.length(stretch) - 1)
        first = F.ascii(stretch)
        return F.when(first == ord(LETTER), power).when(first == ord(DIGIT), power + POWERS).otherwise(F.lit(-1) - first)

    return F.transform(F.regexp_extract_all(F.substr(symbols, F.lit(2)), F.lit(_STRETCH), F.lit(0)), of)


def _moved(alpha: Column, into: Column) -> Column:
    return _log_sum(F.zip_with(alpha, into, lambda a, t: a + t))


def _run_by_run(symbols: Column) -> Column:
    """The recursion over runs, always in log space. A path that can't be taken is
    minus infinity, never null."""
    def step(alpha, at):
        return F.when(at >= 0, F.transform(F.get("pw", at), lambda into: _moved(alpha, into))).otherwise(F.zip_with(
            "lt", "em", lambda into, e: _moved(alpha, into) + _emission(e, F.lit(-1) - at)))

    first = F.zip_with("lp", "em", lambda p, e: p + _emission(e, F.ascii(symbols)))
    return _log_sum(F.aggregate(_steps(symbols), first, step))


def _any_states(states: Column) -> Column:
    lt, em = F.col("lt"), F.col("em")
    first = F.zip_with(F.col("lp"), em, lambda p, e: p + _emission(e, states[0]))

    def step(alpha, x):
        return F.zip_with(lt, em, lambda into, e: _moved(alpha, into) + _emission(e, x))

    return _log_sum(F.aggregate(F.slice(states, F.lit(2), F.size(states)), first, step))


def log_likelihood(symbols: Column) -> Column:
    """Forward recursion over the columns of ``with_score_parameters``.

    The observation array is bound inside the expression: as a column of its
    own it would be inlined several times where a score filter is pushed down.
    """
    k = F.size("em")
    return (
        F.when(k == 1, _single_state(symbols))
        .when(k <= MOST_STATES, _run_by_run(symbols))
        .otherwise(_let(symbol_states(symbols), _any_states))
    )


def score(joined: DataFrame) -> DataFrame:
    """Add ``score`` to observations that carry their model's columns."""
    ready = joined if "lp" in joined.columns else with_score_parameters(joined)
    likelihood = log_likelihood(F.col("symbols"))
    return ready.withColumn("score", likelihood).drop("lp", "lt", "em", "pw")
