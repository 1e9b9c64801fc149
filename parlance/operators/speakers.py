"""Sentences of a piece and the speakers of their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A piece is what one call of a recogniser gives, at most some hundred words: its words are one window.
PIECE = ["piece_id"]


def ends_sentence(text: Column) -> Column:
    """True for a word that ends with a full stop or the like, marks that close a quotation aside."""
    return F.coalesce(F.regexp_replace(text, "[»\"')]+$", "").rlike("[.?!…]$"), F.lit(False))


def with_sentences(words: DataFrame) -> DataFrame:
    """Add sentence: the 0-based number of the word's sentence in its piece."""
    w = Window.partitionBy(*PIECE).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("sentence", F.coalesce(F.sum(ends_sentence(F.col("text")).cast("int")).over(w), F.lit(0)).cast("bigint"))


def with_runs(words: DataFrame, keys: list[str]) -> DataFrame:
    """Add run and run_len: stretches of one speaker inside each sentence."""
    w = Window.partitionBy(*keys).orderBy("pos")
    changed = F.coalesce((~F.lag(F.struct("speaker")).over(w)["speaker"].eqNullSafe(F.col("speaker"))).cast("int"), F.lit(1))
    x = words.withColumn("_c", F.when(F.lag("pos").over(w).isNull(), 1).otherwise(changed))
    x = x.withColumn("run", F.sum("_c").over(w).cast("bigint")).drop("_c")
    return x.withColumn("run_len", F.count("*").over(Window.partitionBy(*keys, "run")).cast("bigint"))


def smooth_by_sentence(words: DataFrame, min_run: int = 4, max_sentence: int = 40) -> DataFrame:
    """Add smoothed: one speaker a sentence, the one of most words (their length decides a tie, then who comes first);
    a run of ``min_run`` words and more of another speaker stays. In a sentence of more than ``max_sentence`` words
    (text without marks) only single words take the speaker of the words before them.

    words: piece_id, pos, text, speaker, start_s, end_s. Untimed words weigh as words of no length; a null speaker is
    a speaker of its own.
    """
    keys = [*PIECE, "sentence"]
    x = with_runs(with_sentences(words.repartition(*PIECE)), keys)  # one partitioning serves all windows
    long = F.coalesce(F.col("end_s") - F.col("start_s"), F.lit(0.0))
    weight = F.lit(1_000_000_000) + F.round(long * 1_000_000).cast("bigint")  # whole numbers: no order of summation matters
    of = Window.partitionBy(*keys, "speaker")
    x = x.withColumns({"_w": -F.sum(weight).over(of), "_p": F.min("pos").over(of)})
    x = x.withColumns({"_m": F.min(F.struct("_w", "_p", F.col("speaker").alias("_s"))).over(Window.partitionBy(*keys)), "_n": F.count("*").over(Window.partitionBy(*keys))}).drop("_w", "_p")
    w = Window.partitionBy(*keys).orderBy("pos")
    anchor = F.when((F.col("run_len") >= 2) | (F.row_number().over(w) == 1), F.struct("speaker"))
    x = x.withColumn("_a", anchor)
    left = F.last("_a", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["speaker"]
    short = F.when(F.col("run_len") < min_run, F.col("_m._s")).otherwise(F.col("speaker"))
    return x.withColumn("smoothed", F.when(F.col("_n") > max_sentence, left).otherwise(short)).drop("_m", "_n", "_a")
