"""Quality rules with adaptive thresholds, in DataFrame operations only.

Every measure of a text is set against fences that follow from the text's own language and source: the
quartiles of the group's texts, and beyond them a multiple of the distance between the two. There are
no fixed cutoffs. Rates enter the quartiles as logarithms with a smoothing count: a text that has none
of something stands at the least rate that its length could show. A text is beyond a fence only if its
count is more (or characters are fewer) than the fence gives in as many words, by as many standard
deviations of such a count; so a short text is not dropped for what chance brings, and one that has no
symbols or repeats not for these.

Quartiles come from quantile sketches that merge: counts of texts by logarithmic buckets (each one
percent wide, so a sketch holds a few hundred counts whatever the group's size). Counts add up in any
order, so reruns agree to the last bit; a language's sketch is the sum of its sources', the corpus's
that of its languages. A group's quartiles are drawn towards its language's, and those towards the
corpus's, by a weight of PRIOR texts; there is no size at which a group changes over from one to the
other. The fences are then joined to the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.base import WORD, checkpointed, cleared, let, written

#: Measure: how many distances between the quartiles the upper fence lies above the upper quartile.
REACH = {"symbol_rate": 2.5, "repeat_rate": 3.0, "dup_line_rate": 3.0, "word_length": 3.0}
#: What a measure counts, and among what.
RATES = {"symbol_rate": ("n_symbols", "n_words"), "repeat_rate": ("n_repeat_words", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words")}
#: The count that a text without any stands for, so that it has a logarithm; every word has a character.
SMOOTH = {"symbol_rate": 1, "repeat_rate": 1, "dup_line_rate": 1, "word_length": 0}
#: Measures with a lower fence as well: words may be too short, but there cannot be too few symbols or repeats.
BOTH_SIDES = ("word_length",)
#: Texts that a language's quartiles count for in a group's, and the corpus's in a language's.
PRIOR = 20
#: Buckets of a sketch for a factor of e.
FINE = 100
BROADCAST_GROUPS = 100_000
#: What measured() adds, in this order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column, window: int = 3) -> Column:
    """Number of words that lie in a window of so many words found at least twice among the words.

    Windows are compared by 64-bit hashes of their words' hashes. Those that repeat are found by
    sorting (hash, place), and only where some hash repeats at all.
    """

    def count(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = F.transform(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
            places = let(same, lambda b: F.array_sort(F.transform(F.filter(s, lambda x, j: F.get(b, j)), lambda x: x["i"])))
            start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
            return F.aggregate(places, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last")))["n"]

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, covered))

    def windows(own: Column) -> Column:
        n = F.size(own) - (window - 1)
        mixed = F.slice(own, F.lit(1), n)
        for k in range(2, window + 1):
            mixed = F.zip_with(mixed, F.slice(own, F.lit(k), n), lambda a, b: F.xxhash64(a, b))
        return let(mixed, count)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(hashed, windows)).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    A null text has none of anything. n_lines counts the lines with a word. Columns of docs with these
    names give way.
    """
    docs, back = cleared(docs, COUNTS, (text_col,), "q_")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    counts = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    x = docs.withColumns({
        "q_counts": counts,
        "q_lines": let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), F.size(F.array_distinct(a)).cast("long").alias("d"))),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
    })
    return back(x.withColumns({
        "n_words": F.col("q_counts.n_words"), "n_repeat_words": F.col("q_counts.n_repeat_words"),
        "n_lines": F.col("q_lines.n"), "n_dup_lines": F.col("q_lines.n") - F.col("q_lines.d"),
    }).drop("q_counts", "q_lines"))


def with_levels(x: DataFrame) -> DataFrame:
    """x with q_<measure>: the logarithms, in buckets, of the measures that have fences; null for a text without words."""
    some = F.col("n_words") > 0
    levels = {m: FINE * F.log((F.col(count) + SMOOTH[m]) / (F.col(n) + SMOOTH[m])) for m, (count, n) in RATES.items()}
    return x.withColumns({f"q_{m}": F.when(some, v) for m, v in levels.items()})


def sketches(levels: DataFrame) -> DataFrame:
    """Counts by q_lang, q_source, q_measure and q_bucket: one quantile sketch for each group and measure."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.ceil(f"q_{m}").cast("long").alias("b")) for m in REACH]))
    rows = levels.select("q_lang", "q_source", each.alias("q_e")).filter("q_e.b IS NOT NULL")
    return rows.groupBy("q_lang", "q_source", F.col("q_e.m").alias("q_measure"), F.col("q_e.b").alias("q_bucket")).agg(F.count("*").alias("q_n"))


def quartiles(sketch: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Of the sketches merged by these columns and the measure: q_total, q_low and q_high (the quartiles' buckets)."""
    keys = [*by, "q_measure"]
    whole = Window.partitionBy(*keys)
    merged = sketch.groupBy(*keys, "q_bucket").agg(F.sum("q_n").alias("q_n"))
    x = merged.withColumns({"q_upto": F.sum("q_n").over(whole.orderBy("q_bucket")), "q_total": F.sum("q_n").over(whole)})
    at = lambda share: F.min(F.when(F.col("q_upto") >= share * F.col("q_total"), F.col("q_bucket")))
    return x.groupBy(*keys).agg(F.first("q_total").alias("q_total"), at(0.25).alias("q_low"), at(0.75).alias("q_high"))


def _drawn(x: DataFrame, to: DataFrame, by: list[str]) -> DataFrame:
    """x with its quartiles drawn towards those of the wider group by PRIOR texts of it."""
    wide = to.select(*by, F.col("q_low").alias("q_wide_low"), F.col("q_high").alias("q_wide_high"))
    draw = lambda c: (F.col("q_total") * F.col(f"q_{c}") + PRIOR * F.col(f"q_wide_{c}")) / (F.col("q_total") + PRIOR)
    return x.join(wide, by).withColumns({"q_low": draw("low"), "q_high": draw("high")}).drop("q_wide_low", "q_wide_high")


def fences(levels: DataFrame) -> DataFrame:
    """One row a group (q_lang, q_source): q_top_<measure> and q_bottom_<measure>, from the levels of texts that passed the base rules."""
    sketch = checkpointed(sketches(levels))
    corpus = quartiles(sketch, ())
    lang = _drawn(quartiles(sketch, ("q_lang",)), corpus, ["q_measure"])
    own = _drawn(quartiles(sketch, ("q_lang", "q_source")), lang, ["q_lang", "q_measure"])
    spread = F.col("q_high") - F.col("q_low")
    measure = F.col("q_measure")
    of = lambda m, v: F.max(F.when(measure == m, v))
    return own.groupBy("q_lang", "q_source").agg(
        *[of(m, F.col("q_high") + r * spread).alias(f"q_top_{m}") for m, r in REACH.items()],
        *[of(m, F.col("q_low") - 1 - REACH[m] * spread).alias(f"q_bottom_{m}") for m in BOTH_SIDES])


def _beyond(measure: str, side: str) -> Column:
    """Whether a text's count is beyond what the fence gives in a text of its length, chance allowed for."""
    (count, n), extra = RATES[measure], SMOOTH[measure]
    due = F.exp(F.col(f"q_{side}_{measure}") / FINE) * (F.col(n) + extra)
    chance = REACH[measure] * F.sqrt(due + 1)
    return F.col(count) + extra > due + chance if side == "top" else F.col(count) + extra < due - chance


def verdicts(measures: DataFrame, lang_col: str = "lang", source_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Rows of measured(), which are read twice, with base_failed and kept; see judge."""
    measures, back = cleared(measures, ("base_failed", "kept"), (lang_col, source_col, *COUNTS), "q_")
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    x = with_levels(measures).withColumns({"q_lang": group(lang_col), "q_source": group(source_col), "base_failed": failed})
    table = checkpointed(fences(x.filter(~failed)))
    table = F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table
    beyond = [_beyond(m, "top") for m in REACH] + [_beyond(m, "bottom") for m in BOTH_SIDES]
    out = x.join(table, ["q_lang", "q_source"], "left").withColumn("kept", ~F.col("base_failed") & ~F.coalesce(reduce(Column.__or__, beyond), F.lit(False)))
    return back(out.drop("q_lang", "q_source", *[f"q_{m}" for m in REACH], *[f"q_top_{m}" for m in REACH], *[f"q_bottom_{m}" for m in BOTH_SIDES]))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """docs with the counts of measured, base_failed and kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in repeated
    windows. kept: false for these, else whether every measure is within its group's fences. Texts
    that failed take no part in the sketches. A null language or source is a group of its own; a null or
    empty text fails. Repeated rows are texts each. An empty table stays empty. Columns of docs with the
    names of the new ones give way to them; the read columns must not have such names.
    """
    docs, _ = cleared(docs, (*COUNTS, "base_failed", "kept"), (text_col, lang_col, source_col))
    return verdicts(written(measured(docs, text_col)), lang_col, source_col, min_words, max_repeat_percent)
