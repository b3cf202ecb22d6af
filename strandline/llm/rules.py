"""Quality rules by weak supervision, with Spark expressions only.

Each rule votes good (1) or bad (-1) or abstains (0). The model: a document is good or bad; whether a rule votes does not depend on that,
how it votes does. Expectation-maximisation over the counts of vote patterns, at most 3 to the number of rules, estimates each
rule's accuracy on good and on bad documents; the posterior probability of good decides, instead of asking that all rules pass.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import WORD, materialize

BLANKS, SYMBOLS, CAPITALS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]", "[A-Z]"
#: Beliefs before any document is seen, as counts of documents: a vote is right so often, and so many are good.
PRIOR_STRENGTH, PRIOR_RIGHT, PRIOR_GOOD = 20.0, 0.85, 0.8
#: Most steps, and the change of all parameters at which they end.
STEPS, TOLERANCE = 300, 1e-6
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def let(value: Column, body) -> Column:
    """Binds a value to a variable, so that it is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(values: Column) -> Column:
    """Places, ascending, of the elements of (``g``, ``i``) structs whose ``g`` occurs twice or more."""
    same = lambda s, x, k: (k > 0) & (F.get(s, k - 1)["g"] == x["g"]) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False))
    kept = let(F.sort_array(values), lambda s: F.filter(s, lambda x, k: same(s, x, k)))
    return F.sort_array(F.transform(kept, lambda x: x["i"]))


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Hashes rule out most windows; strings decide about the others."""

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

    def window(of, i: Column) -> Column:
        return of(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))

    def exact(h: Column) -> Column:
        suspects = _repeated(F.transform(h, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        grams = F.transform(suspects, lambda i: F.struct(window(lambda *w: F.concat_ws(" ", *w), i).alias("g"), i.alias("i")))
        return let(_repeated(grams), covered)

    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h)))
    return F.coalesce(count, F.lit(0)).cast("long")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines`` and ``n_capitals`` (all long).

    A null or empty text has zeros throughout. Lines are cut at ``\\n``; a line without a word is no duplicate. Columns of the input
    with these names are replaced.
    """
    taken = [c for c in df.columns if c.lower() not in STATISTICS]
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, BLANKS, -1), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("repeat")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    marked = df.select(*taken, of_words.alias("_w"), of_lines.alias("_l"), t.alias("_t"))
    found = {
        "n_words": F.col("_w.n"), "word_chars": F.col("_w.chars"), "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)), "n_dup_lines": F.col("_l.n") - F.col("_l.d"),
        "n_repeat_words": F.col("_w.repeat"), "n_lines": F.col("_l.n"), "n_capitals": F.regexp_count("_t", F.lit(CAPITALS)),
    }
    return marked.select(*taken, *(found[name].cast("long").alias(name) for name in STATISTICS))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, over the columns of :func:`statistics`."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    mean, symbols, capitals = F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_capitals") / chars
    repeats, lines = F.col("n_repeat_words") / words, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))
    return {
        "length": _vote(F.col("n_words") >= 100, F.col("n_words") < 50),
        "word_length": _vote(mean.between(3, 9), (mean < 2) | (mean > 16)),
        "symbols": _vote(symbols < 0.05, symbols > 0.3),
        "capitals": _vote(capitals < 0.1, capitals > 0.4),
        "repeats": _vote(repeats < 0.1, repeats > 0.4),
        "lines": _vote(lines < 0.05, lines > 0.3),
    }


@dataclass(frozen=True)
class Model:
    """The share of good documents, and for each rule how often its votes say good on good and on bad documents."""

    share: float
    rates: tuple[tuple[float, float], ...]
    steps: int
    moved: float


def fit(patterns: DataFrame, rules: list[str], steps: int = STEPS) -> Model:
    """Estimates the model from a row for each vote pattern (columns ``rules``) with its count ``n``.

    The patterns, at most 3 to the number of rules and so of a bounded number, become one row; one expression takes all steps over it.
    The rates are the maximum of the likelihood of all votes times the priors, and no step lowers that. Warns if the last step still moved
    a parameter by more than TOLERANCE.
    """
    one = patterns.select(F.struct(F.array(*(F.col(r).cast("int") for r in rules)).alias("votes"), F.col("n").cast("double").alias("n")).alias("p"))
    one = one.agg(F.sort_array(F.collect_list("p")).alias("patterns"))

    def odds(votes: Column, s: Column) -> Column:
        terms = F.zip_with(votes, s["weights"], lambda v, w: F.when(v == 1, w["up"]).when(v == -1, w["down"]).otherwise(F.lit(0.0)))
        return F.aggregate(terms, F.log(s["share"] / (1 - s["share"])), lambda total, x: total + x)

    def state(share: Column, rates: Column, moved: Column, done: Column) -> Column:
        weight = lambda x: F.struct(F.log(x["good"] / x["bad"]).alias("up"), F.log((1 - x["good"]) / (1 - x["bad"])).alias("down"))
        return F.struct(share.alias("share"), rates.alias("rates"), F.transform(rates, weight).alias("weights"), moved.alias("moved"), done.alias("steps"))

    def total(scored: Column, value) -> Column:
        return F.aggregate(scored, F.lit(0.0), lambda sum_, p: sum_ + value(p))

    def rate(scored: Column, r: int, of: str, prior: float) -> Column:
        vote = lambda p: F.get(p["votes"], F.lit(r))
        up, any_ = total(scored, lambda p: F.when(vote(p) == 1, p[of]).otherwise(0.0)), total(scored, lambda p: F.when(vote(p) != 0, p[of]).otherwise(0.0))
        return (up + prior * PRIOR_STRENGTH) / (any_ + PRIOR_STRENGTH)

    def step(s: Column, scored: Column) -> Column:
        good, all_ = total(scored, lambda p: p["good"]), total(scored, lambda p: p["good"] + p["bad"])
        rates = F.array(*(F.struct(rate(scored, r, "good", PRIOR_RIGHT).alias("good"), rate(scored, r, "bad", 1 - PRIOR_RIGHT).alias("bad")) for r in range(len(rules))))
        new = F.struct(((good + PRIOR_GOOD * PRIOR_STRENGTH) / (all_ + PRIOR_STRENGTH)).alias("share"), rates.alias("rates"))
        apart = lambda n: F.array_max(F.zip_with(n["rates"], s["rates"], lambda x, y: F.greatest(F.abs(x["good"] - y["good"]), F.abs(x["bad"] - y["bad"]))))
        return let(new, lambda n: state(n["share"], n["rates"], F.greatest(F.abs(n["share"] - s["share"]), apart(n)), s["steps"] + 1))

    def advance(s: Column, _: Column) -> Column:
        chance = lambda p: 1 / (1 + F.exp(-odds(p["votes"], s)))
        scored = F.transform("patterns", lambda p: let(chance(p), lambda c: F.struct(p["votes"].alias("votes"), (p["n"] * c).alias("good"), (p["n"] * (1 - c)).alias("bad"))))
        return F.when(s["moved"] < TOLERANCE, s).otherwise(let(scored, lambda x: step(s, x)))

    begin = F.array(*[F.struct(F.lit(PRIOR_RIGHT).alias("good"), F.lit(1 - PRIOR_RIGHT).alias("bad")) for _ in rules])
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state(F.lit(PRIOR_GOOD), begin, F.lit(1.0), F.lit(0)), advance)
    found = one.select(end.alias("s")).select("s.share", "s.rates", "s.moved", "s.steps").first()
    if found["moved"] >= TOLERANCE:
        warnings.warn(f"the rules' accuracies still moved by {found['moved']:.1e} after {found['steps']} steps", stacklevel=2)
    return Model(found["share"], tuple((x["good"], x["bad"]) for x in found["rates"]), found["steps"], found["moved"])


def posterior(model: Model, rules: list[str]) -> Column:
    """Probability of a good document given the vote columns; an abstention says nothing."""
    odds = F.lit(math.log(model.share / (1 - model.share)))
    for r, (good, bad) in zip(rules, model.rates):
        odds = odds + F.when(F.col(r) == 1, math.log(good / bad)).when(F.col(r) == -1, math.log((1 - good) / (1 - bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(df: DataFrame, text: str = "text", keep_all: tuple[str, ...] | None = None) -> DataFrame:
    """Scores every row: the columns asked for (all by default), the statistics, ``base_failed``, ``quality`` and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated windows. ``quality`` is the posterior; ``kept``
    asks for no base failure and a posterior of one half or more. The texts are read once: the columns asked for and the
    statistics are stored in the shared folder. An abstention says nothing. Null and empty texts fail; equal rows are judged alike; an
    empty table gives no rows. Columns of the input with the names of new ones are replaced.
    """
    new = {"base_failed", "quality", "kept", *STATISTICS}
    columns = [c for c in (keep_all or df.columns) if c.lower() not in new]
    rules = votes()
    names = {r: f"_vote_{r}" for r in rules}
    scored = statistics(df.select(*dict.fromkeys([*columns, text])), text).select(*columns, *STATISTICS)
    scored = materialize(scored.withColumns({names[r]: v for r, v in rules.items()}), "rules")
    model = fit(scored.groupBy(*names.values()).agg(F.count("*").alias("n")), list(names.values()))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = scored.withColumns({"base_failed": failed, "quality": posterior(model, list(names.values()))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop(*names.values())
