"""Whether quotes occur in texts: a containment join that scales.

Every quote is looked up by one of its word runs: all runs of PROBE words of the texts meet, by an
equi-join on a hash, the first PROBE inner words of the quotes. Quotes of one or two words, whose words
may be parts of longer ones, are looked up by their first letters: they meet the letter runs of the
texts' different words (or pairs of words). Only the hash and the text's id take part in that; the text
is joined to the pairs that met, and only these are compared as text. Without a shared run a quote can't
be contained, so nothing is lost, and no text meets all quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.functions.text import match_form

PROBE, LETTERS = 4, 3


def runs(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by blanks; an empty array if there are fewer."""
    shifted = [F.slice(tokens, k + 1, F.greatest(F.size(tokens) - n + 1, F.lit(0))) for k in range(n)]
    return shifted[0] if n == 1 else F.transform(F.arrays_zip(*(c.alias(f"w{k}") for k, c in enumerate(shifted))), lambda w: F.concat_ws(" ", *(w[f"w{k}"] for k in range(n))))


def by_words(quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str, lengths: list[int]) -> DataFrame:
    """Pairs whose text holds the quote's first n inner words in a row, n being the quote's own: one pass
    over the texts' words for all lengths. Runs are hashed word by word and never put together."""
    word = lambda n: [F.get("_words", F.lit(1 + k)) for k in range(n)]
    hashed = F.lit(None).cast("long")
    for n in lengths:
        hashed = F.when(F.col("_n") == n, F.xxhash64(F.lit(n), *word(n))).otherwise(hashed)
    probe = quotes.filter("_n > 0").select(quote_id, hashed.alias("_run"))
    units = texts.select(text_id, F.explode(F.array_distinct(F.concat(*(hashed_runs(F.col("_words"), n) for n in lengths)))).alias("_run"))
    return units.join(probe, "_run").select(quote_id, text_id).distinct()


def hashed_runs(tokens: Column, n: int) -> Column:
    """The hash of each run of n tokens."""
    if n == 1:
        return F.transform(tokens, lambda w: F.xxhash64(F.lit(n), w))
    shifted = [F.slice(tokens, k + 1, F.greatest(F.size(tokens) - n + 1, F.lit(0))).alias(f"w{k}") for k in range(n)]
    return F.transform(F.arrays_zip(*shifted), lambda w: F.xxhash64(F.lit(n), *(w[f"w{k}"] for k in range(n))))


def by_letters(quotes: DataFrame, texts: DataFrame, quote_id: str, text_id: str, n: int) -> DataFrame:
    """Pairs of quotes of n words and texts of which n words in a row hold the quote."""
    short = quotes.filter((F.col("_n") == 0) & (F.size("_words") == n))
    probe = short.select(quote_id, "_quote", F.substring("_quote", 1, LETTERS).alias("_letters"))
    units = texts.select(text_id, F.explode(runs(F.col("_words"), n)).alias("_unit")).distinct()
    kinds = units.select("_unit").distinct()
    places = F.sequence(F.lit(1), F.length("_unit"))
    lettered = F.flatten(F.transform(places, lambda i: F.array(*(F.substring("_unit", i, F.lit(k)) for k in range(1, LETTERS + 1)))))
    met = kinds.select("_unit", F.explode(F.array_distinct(lettered)).alias("_letters")).join(probe, "_letters").filter(F.contains("_unit", F.col("_quote")))
    return units.join(met.select("_unit", quote_id).distinct(), "_unit").select(quote_id, text_id).distinct()


def contained(quotes: DataFrame, texts: DataFrame, quote_id: str, quote: str, text_id: str, text: str) -> DataFrame:
    """(quote_id, text_id) of quotes that a text contains, both in match form.

    The quote's first and last word may be part of a longer one in the text, so the run is taken from
    its inner words; quotes of fewer than PROBE inner words are probed by fewer. Which lengths there
    are is asked of the quotes first (PROBE + 2 numbers), so that texts aren't cut for nothing."""
    q = quotes.select(F.col(quote_id), match_form(F.col(quote)).alias("_quote")).filter("_quote <> ''").withColumn("_words", F.split("_quote", " "))
    q = q.withColumn("_n", F.greatest(F.least(F.lit(PROBE), F.size("_words") - 2), F.lit(0)))
    cut = texts.select(F.col(text_id), F.split(match_form(F.col(text)), " ").alias("_words"))
    kinds = {(r["_n"], min(r["w"], 3)) for r in q.select("_n", F.size("_words").alias("w")).distinct().collect()}
    lengths = sorted({n for n, _ in kinds if n})
    met = [by_words(q, cut, quote_id, text_id, lengths)] if lengths else []
    met += [by_letters(q, cut, quote_id, text_id, w) for w in sorted({w for n, w in kinds if not n})]
    pairs = met[0] if met else by_words(q, cut, quote_id, text_id, [PROBE])
    for more in met[1:]:
        pairs = pairs.union(more)
    # of the texts only those that met a quote are folded again
    found = pairs.distinct().join(texts.select(text_id, F.col(text).alias("_raw")), text_id).withColumn("_text", match_form(F.col("_raw")))
    return found.join(q.select(quote_id, "_quote"), quote_id).filter(F.contains("_text", F.col("_quote"))).select(quote_id, text_id).distinct()


def downgrade(skills: Column) -> Column:
    """Skills said to be demonstrated whose quote didn't hold become merely listed."""
    failed = lambda s: (s["evidenceType"] == "demonstrated") & ~F.coalesce(s["evidenceVerified"], F.lit(True))
    return F.transform(skills, lambda s: s.withField("evidenceType", F.when(failed(s), F.lit("listed")).otherwise(s["evidenceType"])))
