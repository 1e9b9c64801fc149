"""Choosing among decoding attempts: the retry ladder, the last resort, batches and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.loops import collapse_udf, issues

# How each attempt decodes.
LADDER = (
    {"do_sample": False},
    {"do_sample": False, "repetition_penalty": 1.1},
    {"do_sample": True, "temperature": 0.3, "top_p": 0.9, "repetition_penalty": 1.1},
)


def diagnosed(attempts: DataFrame) -> DataFrame:
    """attempts with issues. attempts: recording, span_id, start_s, end_s, rung, text, hit_limit, stop_reason."""
    return attempts.withColumn("issues", issues(F.col("text"), F.col("end_s") - F.col("start_s"), F.col("hit_limit"), F.col("stop_reason")))


def word_cap(seconds: Column, max_wps: float = 6.0) -> Column:
    """Words that so many seconds can hold, and five."""
    return F.floor(F.greatest(seconds, F.lit(1.0)) * max_wps).cast("int") + 5


def capped(text: Column, seconds: Column, max_wps: float = 6.0) -> Column:
    """The first words of a text, as many as its span can hold."""
    return F.array_join(F.slice(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""), F.lit(1), word_cap(seconds, max_wps)), " ")


def resolved(attempts: DataFrame, max_wps: float = 6.0, least_s: float = 0.2) -> DataFrame:
    """recording, span_id, start_s, end_s, text, flags, rung: the piece of each span.

    The first attempt without issues counts, flagged 'retry' beyond the first rung. Where all have issues, the one
    with the fewest, then the shortest, then the first, with its repetitions collapsed and its words capped, flagged
    'loop_trimmed' and its issues. Spans shorter than ``least_s`` give nothing. ``attempts`` have their issues.
    """
    a = attempts.where(F.col("end_s") - F.col("start_s") >= least_s)
    rank = F.struct(F.when(F.size("issues") == 0, 0).otherwise(1).alias("bad"), F.when(F.size("issues") == 0, F.lit(0)).otherwise(F.size("issues")).alias("n"), F.when(F.size("issues") == 0, F.lit(0)).otherwise(F.length("text")).alias("l"), "rung")
    best = a.groupBy("recording", "span_id").agg(F.min_by(F.struct("start_s", "end_s", "text", "issues", "rung"), rank).alias("b")).select("recording", "span_id", "b.*")
    good = best.where(F.size("issues") == 0).withColumn("flags", F.when(F.col("rung") > 0, F.array(F.lit("retry"))).otherwise(F.array().cast("array<string>")))
    bad = best.where(F.size("issues") > 0).withColumn("flags", F.concat(F.array(F.lit("loop_trimmed")), "issues"))
    bad = bad.withColumn("text", capped(collapse_udf("text"), F.col("end_s") - F.col("start_s"), max_wps))  # only these meet Python
    return good.unionByName(bad).select("recording", "span_id", "start_s", "end_s", "text", "flags", "rung")


def pending(attempts: DataFrame, rung: int) -> DataFrame:
    """recording, span_id of spans that no attempt up to ``rung`` has solved."""
    done = attempts.where((F.col("rung") <= rung) & (F.size("issues") == 0)).select("recording", "span_id")
    return attempts.select("recording", "span_id").distinct().join(done, ["recording", "span_id"], "left_anti")


def batches(spans: DataFrame, size: int = 16, parts: int = 64, part: Column | None = None) -> DataFrame:
    """spans with batch: longest first, so that the spans of a batch are alike. Spans are ranked within parts (of a hash
    by default), so that ranking is no one task's work."""
    part = F.pmod(F.xxhash64("recording", "span_id"), F.lit(parts)) if part is None else part
    w = Window.partitionBy("_part").orderBy(F.desc(F.col("end_s") - F.col("start_s")), "recording", "span_id")
    return spans.withColumn("_part", part).withColumn("batch", F.concat_ws("-", F.col("_part").cast("string"), F.floor((F.row_number().over(w) - 1) / size).cast("string"))).drop("_part")


def token_budget(longest_s: Column, base: float, rate: float) -> Column:
    """New tokens a batch may have."""
    return F.floor(F.lit(base) + longest_s * rate).cast("int")


def hit_budget(tokens: Column, budget: Column, eos: list[int], stop_reason: Column) -> Column:
    """True for a row that ran into its budget: not stopped, as long as the budget but for eight, and never ended."""
    return stop_reason.isNull() & (F.size(tokens) >= budget - 8) & ~F.arrays_overlap(tokens, F.array(*[F.lit(e) for e in eos]))
