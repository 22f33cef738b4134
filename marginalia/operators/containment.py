"""Which texts hold which others, by an index of their character trigrams instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram, and texts of a posting list from which on it is dealt out in pieces of so many.
GRAM, PIECE = 3, 10_000
#: Long posting lists that are broadcast by name at most; beyond, Spark chooses how they meet.
LONG_LISTS = 100_000


def _grams(x: Column, sizes: list[int]) -> Column:
    """The different stretches of x of the sizes; the empty one is in every text."""
    of = lambda n: F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[F.array(F.lit("")) if n == 0 else of(n) for n in sizes]))


def containing(texts: DataFrame, parts: DataFrame, text: str = "said", part: str = "asked") -> DataFrame:
    """text, part: of the different texts and the different parts the pairs in which the text holds the part.

    A part of three characters or more is looked up by that of its trigrams which the fewest texts have, a
    shorter one by itself, and what is found is compared in full. Posting lists of many texts are dealt out
    in pieces, to each of which the parts go that look there, so that a trigram that most texts have is not
    one task. A part with a trigram that no text has is dropped at once. The empty part is in every text; nulls
    are in none and hold none. Both sides may have any number of rows and repeats.
    """
    said, asked = texts.select(F.col(text).alias("ct_text")).filter("ct_text IS NOT NULL").distinct(), parts.select(F.col(part).alias("ct_part")).filter("ct_part IS NOT NULL").distinct()
    sizes = sorted(r[0] for r in asked.select(F.least(F.length("ct_part"), F.lit(GRAM)).alias("n")).distinct().collect())  # four at most
    wanted = asked.select("ct_part", F.explode(F.when(F.length("ct_part") <= GRAM, F.array("ct_part")).otherwise(_grams(F.col("ct_part"), [GRAM]))).alias("ct_gram"))
    postings = said.select("ct_text", F.explode(_grams(F.col("ct_text"), sizes)).alias("ct_gram")) if sizes else said.select("ct_text", F.lit("").alias("ct_gram")).limit(0)
    counts = postings.groupBy("ct_gram").agg(F.count("*").alias("ct_n"))
    rarest = wanted.join(counts, "ct_gram", "left").groupBy("ct_part").agg(F.min(F.struct(F.coalesce("ct_n", F.lit(0)).alias("n"), F.col("ct_gram").alias("gram"))).alias("r"))
    pieces = F.ceil(F.col("r.n") / PIECE).cast("int")
    look = rarest.filter("r.n > 0").select("ct_part", F.col("r.gram").alias("ct_gram"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("ct_piece"))
    long = counts.filter(F.col("ct_n") > PIECE).select(F.col("ct_gram").alias("ct_long"), F.ceil(F.col("ct_n") / PIECE).alias("ct_pieces"))
    if long.limit(LONG_LISTS + 1).count() <= LONG_LISTS:
        long = F.broadcast(long)
    dealt = postings.join(long, F.col("ct_gram") == F.col("ct_long"), "left")
    dealt = dealt.select("ct_text", "ct_gram", F.coalesce(F.pmod(F.xxhash64("ct_text"), F.col("ct_pieces")), F.lit(0)).cast("int").alias("ct_piece"))
    found = look.join(dealt, ["ct_gram", "ct_piece"]).filter(F.col("ct_text").contains(F.col("ct_part")))
    return found.select(F.col("ct_text").alias(text), F.col("ct_part").alias(part))
