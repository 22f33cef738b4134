"""Vectors, distributions, scores and budgets as functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import ColumnOrName, _c, language_mixed, text


def _double(v: ColumnOrName) -> Column:
    return _c(v).cast("array<double>")


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: ColumnOrName) -> Column:
    """Euclidean length, 1 for a zero vector."""
    n = F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: ColumnOrName, b: ColumnOrName, norm_a: ColumnOrName | None = None, norm_b: ColumnOrName | None = None) -> Column:
    return dot(a, b) / ((norm(a) if norm_a is None else _c(norm_a)) * (norm(b) if norm_b is None else _c(norm_b)))


# Likert distributions --------------------------------------------------------------------------


def likert_text(output: ColumnOrName) -> Column:
    """A judge's distribution: what stands between the output tags, else the text without them."""
    t = text(output)
    inside = F.regexp_extract(t, r"(?s)<OUTPUT>\s*(.*?)\s*</OUTPUT>", 1)
    return F.when(t.rlike(r"(?s)<OUTPUT>.*?</OUTPUT>"), inside).otherwise(F.regexp_replace(t, "</?OUTPUT>", ""))


def distribution(output: ColumnOrName, scale: tuple[int, ...]) -> Column:
    """map<int, double> over the scale that sums to 1.

    Values are read from pairs of a quoted number and a number; what is missing, negative or no number
    is 0. If nothing is left all scores have the same weight.
    """
    t = likert_text(output)

    def of(score: int) -> Column:
        found = F.regexp_extract(t, rf"""["']?\b{score}["']?\s*:\s*["']?(-?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)""", 1).try_cast("double")
        return F.when(F.isnan(found) | (found < 0), 0.0).otherwise(F.coalesce(found, F.lit(0.0)))

    raw = F.array(*[of(s) for s in scale])
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    share = F.when(total > 0, F.transform(raw, lambda x: x / total)).otherwise(F.array_repeat(F.lit(1.0 / len(scale)), len(scale)))
    return F.map_from_arrays(F.array(*[F.lit(s) for s in scale]), share)


def expected_score(shares: Column) -> Column:
    """Mean score of a distribution."""
    return F.aggregate(F.map_entries(shares), F.lit(0.0), lambda a, e: a + e["key"] * e["value"])


# Gate ------------------------------------------------------------------------------------------


def language_score(question: ColumnOrName, answer: ColumnOrName, wanted: ColumnOrName) -> Column:
    """2 if both are in the wanted language, 1.5 if mixed, else 1."""
    found = language_mixed(F.concat(text(question), F.lit("\n"), text(answer)))
    return F.when(found == _c(wanted), 2.0).when(found == "hien", 1.5).otherwise(1.0)


def mean_score(*scores: ColumnOrName) -> Column:
    """Mean of the scores that are there, to two decimals, half to even; null if none is."""
    there = F.filter(F.array(*[_c(s).cast("double") for s in scores]), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.bround(F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there), 2))


def alignment(level: ColumnOrName, depth: ColumnOrName, *gates: ColumnOrName, enabled: Column | None = None, least: float = 1.5, failed: float = 0.0) -> Column:
    """Mean of two scores to two decimals, half to even; failed (once 0.1) if a gate is below least; null if not enabled."""
    fails = F.lit(False)
    for g in gates:
        fails = fails | (_c(g) < least)
    score = F.when(fails, failed).otherwise(F.when(_c(level).isNotNull() & _c(depth).isNotNull(), mean_score(level, depth)))
    return score if enabled is None else F.when(enabled, score)


# Budgets ---------------------------------------------------------------------------------------


def token_budget(model: ColumnOrName, n: ColumnOrName, kind: ColumnOrName, cap: ColumnOrName | None = None, least: int = 256, most: int = 8192) -> Column:
    """Output tokens that a request may take; the guard model has its own figure."""
    asked = 6000 + 350 * F.greatest(F.lit(1), F.coalesce(_c(n), F.lit(1))) + F.when(text(kind).contains("Multiple Choice"), 120).otherwise(0)
    budget = F.when(_c(model) == "groq-llama-guard", 512).otherwise(F.greatest(F.lit(least), F.least(asked, F.lit(most))))
    return budget.cast("int") if cap is None else F.greatest(F.lit(least), F.least(budget, _c(cap))).cast("int")


def clamp(x: ColumnOrName, low: float, high: float, default: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(_c(x), F.lit(default))))


def score_color(score: ColumnOrName) -> Column:
    return F.when(_c(score).isNull(), "none").when(_c(score) >= 3.5, "good").when(_c(score) >= 2, "fair").otherwise("poor")


def score_percent(score: ColumnOrName, top: float = 5.0) -> Column:
    """Of the top score, within 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(_c(score) / top * 100))).cast("int")


def percent_band(percent: ColumnOrName) -> Column:
    return F.when(_c(percent) >= 70, "high").when(_c(percent) >= 40, "middle").otherwise("low")


def old_score_color(score: ColumnOrName) -> Column:
    """The older scale of 0 to 100."""
    return F.when(_c(score).isNull(), "none").when(_c(score) < 33, "poor").when(_c(score) <= 66, "fair").otherwise("good")
