"""What neural models give, as plug-ins: producers of turn, hypothesis and frame tables.

No model is part of the library. A plug-in maps a DataFrame to a DataFrame, as a rule with ``mapInPandas`` and a model
kept per Python worker; precomputed tables are the default plug-ins.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.alignment import log_softmax


@dataclass(frozen=True)
class HypothesisLimits:
    """What a recogniser takes and gives: sample rate, longest input, tokens of a batch, batch size, a text prompt."""

    sample_rate: int
    longest_s: float
    base_tokens: int
    tokens_per_s: float
    batch: int
    context: bool = False
    returns_prompt: bool = True  # what comes out begins with what went in


# The known recognisers.
HYPOTHESIS_SOURCES: dict[str, HypothesisLimits] = {
    "cohere": HypothesisLimits(16_000, 35.0, 24, 12.0, 16),
    "vibevoice": HypothesisLimits(24_000, 3600.0, 80, 15.0, 1, True),
    "whisper-fr": HypothesisLimits(16_000, 30.0, 24, 12.0, 16, True, False),
}
# Languages with an aligner of their own; others need a model's name.
ALIGNER_LANGS = ("fr", "en", "de", "es", "it", "pt", "nl", "pl")


def limits(name: str, context: str | None = None) -> HypothesisLimits:
    """The limits of a recogniser; an error for an unknown one, and for a prompt that it can't take."""
    if name not in HYPOTHESIS_SOURCES:
        raise ValueError(f"unknown hypothesis source {name!r}; known: {', '.join(HYPOTHESIS_SOURCES)}")
    got = HYPOTHESIS_SOURCES[name]
    if context and not got.context:
        raise ValueError(f"{name} takes no context")
    return got


def generated(tokens: Column, prompt_tokens: Column, source: str) -> Column:
    """The tokens that a recogniser has made: without its prompt, where that comes out too."""
    n = prompt_tokens if limits(source).returns_prompt else F.lit(0)
    return F.slice(tokens, n + 1, F.greatest(F.size(tokens) - n, F.lit(0)))


def check_aligner(lang: str, model: str | None = None) -> None:
    if lang not in ALIGNER_LANGS and model is None:
        raise ValueError(f"no aligner for {lang!r}: name a model")


class DiarizationModel(ABC):
    @abstractmethod
    def turns(self, recordings: DataFrame) -> DataFrame:
        """recording, ord, start_s, end_s, speaker of recordings."""


class HypothesisModel(ABC):
    limits: HypothesisLimits

    @abstractmethod
    def attempts(self, spans: DataFrame, rung: int) -> DataFrame:
        """recording, span_id, start_s, end_s, rung, text, hit_limit, stop_reason of spans."""


class EmissionModel(ABC):
    @abstractmethod
    def emissions(self, spans: DataFrame) -> DataFrame:
        """recording, span_id, frame, logp of spans."""


class LanguageModel(ABC):
    @abstractmethod
    def confidences(self, texts: DataFrame) -> DataFrame:
        """texts with confidence MAP<STRING, DOUBLE>."""


class Stored(DiarizationModel, HypothesisModel, EmissionModel):
    """Precomputed tables in place of a model."""

    def __init__(self, table: DataFrame, limits: HypothesisLimits | None = None):
        self.table, self.limits = table, limits

    def turns(self, recordings: DataFrame) -> DataFrame:
        x = self.table.select("recording", "ord", F.col("start_s").cast("double"), F.col("end_s").cast("double"), F.col("speaker").cast("int"))
        return x.join(recordings.select("recording").distinct(), "recording", "left_semi")

    def attempts(self, spans: DataFrame, rung: int) -> DataFrame:
        return self.table.where(F.col("rung") == rung).join(spans.select("recording", "span_id").distinct(), ["recording", "span_id"], "left_semi")

    def emissions(self, spans: DataFrame) -> DataFrame:
        return self.table.join(spans.select("recording", "span_id").distinct(), ["recording", "span_id"], "left_semi")


def emissions_of(scores: DataFrame, column: str = "scores") -> DataFrame:
    """scores with logp: the log softmax of each frame's scores."""
    return scores.withColumn("logp", log_softmax(F.col(column)))


def frame_seconds(samples: int, rate: int, frames: int) -> float:
    return samples / rate / frames


def with_ladder(model: HypothesisModel, spans: DataFrame, rungs: int, diagnose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All attempts of a model: each rung sees only the spans that no rung before it has solved."""
    todo, done = spans, None
    for rung in range(rungs):
        got = diagnose(model.attempts(todo, rung))
        done = got if done is None else done.unionByName(got)
        solved = got.where(F.size("issues") == 0).select("recording", "span_id")
        todo = todo.join(solved, ["recording", "span_id"], "left_anti")
    return done
