"""How far transcripts are from each other, and what they keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import by_row

from ..functions.text import FILLERS, french_numbers
from ..operators.alignment import word_distance


def comparable_words(text: str | None) -> list[str]:
    """Words without fillers, numbers in digits."""
    import re

    t = re.sub(FILLERS, "", text or "", flags=re.I)
    return re.findall(r"\w+", (french_numbers(t)[0] or "").lower())


word_gap_udf = by_row("struct<edits int, longest int>", ["edits", "longest"])(lambda a, b: (lambda x, y: (word_distance(x, y), max(len(x), len(y))))(comparable_words(a), comparable_words(b)))


def plain_words(text: str | None) -> list[str]:
    import re

    return re.findall(r"\w+", (text or "").lower())


plain_gap_udf = by_row("struct<edits int, longest int>", ["edits", "longest"])(lambda a, b: (lambda x, y: (word_distance(x, y), max(len(x), len(y))))(plain_words(a), plain_words(b)))


def word_gap(pairs: DataFrame, a: str = "text_a", b: str = "text_b", plain: bool = False) -> DataFrame:
    """pairs with edits, longest and gap: the word edit distance over the longer text's words (0 for two empty ones).
    ``plain`` takes words as they are; else fillers are left out and numbers are in digits."""
    x = pairs.withColumn("_g", (plain_gap_udf if plain else word_gap_udf)(a, b))
    gap = F.when(F.col("_g.longest") > 0, F.col("_g.edits") / F.col("_g.longest")).otherwise(F.lit(0.0))
    return x.withColumns({"edits": F.col("_g.edits"), "longest": F.col("_g.longest"), "gap": gap}).drop("_g")


def agreement(texts: DataFrame, systems: list[str], plain: bool = False) -> DataFrame:
    """system_a, system_b, gap: edits over words of each two of a few systems. texts: unit, system, text — a pair of
    systems meets on the unit (a span, a recording)."""
    x = texts.where(F.col("system").isin(*systems))
    a = x.select("unit", F.col("system").alias("system_a"), F.col("text").alias("text_a"))
    b = x.select("unit", F.col("system").alias("system_b"), F.col("text").alias("text_b"))
    pairs = word_gap(a.join(b, "unit").where(F.col("system_a") < F.col("system_b")), plain=plain)
    return pairs.groupBy("system_a", "system_b").agg(F.sum("edits").alias("edits"), F.sum("longest").alias("words")).withColumn("gap", F.when(F.col("words") > 0, F.col("edits") / F.col("words")).otherwise(0.0))


def kept_style(segments: DataFrame, by: str, terms: list[str] = []) -> DataFrame:  # noqa: B006
    """by, segments, hesitations, capital_share, term_hits: what a system keeps."""
    text = F.coalesce("text", F.lit(""))
    hits = F.lit(0)
    for t in terms:
        hits = hits + F.regexp_count(text, F.lit(rf"(?iU)(?<!\w)\Q{t}\E(?!\w)"))
    return segments.groupBy(by).agg(
        F.count("*").alias("segments"),
        F.sum(F.regexp_count(text, F.lit(f"(?iU){FILLERS}"))).cast("bigint").alias("hesitations"),
        F.round(F.avg(text.rlike(r"^\p{Lu}").cast("int")), 6).alias("capital_share"),
        F.sum(hits).cast("bigint").alias("term_hits"),
    )


def secondary_share(fused: DataFrame) -> DataFrame:
    """windows, words, regions, number_variants, secondary_chosen and share of regions taken from the second transcript."""
    names = ["windows", "words", "regions", "number_variants", "secondary_chosen"]
    x = fused.agg(*[F.sum(n).cast("bigint").alias(n) for n in names])
    return x.withColumn("share", F.when(F.col("regions") > 0, F.round(F.col("secondary_chosen") / F.col("regions"), 6)))


