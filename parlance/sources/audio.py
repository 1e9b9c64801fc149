"""Sound as a table: wave files in blocks of samples, and slices of them."""

from __future__ import annotations

import io
import os
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "recording string, path string, rate int, from_s double, samples array<float>"
_WIDTHS = {1: (np.uint8, 128.0, 128.0), 2: (np.int16, 0.0, 32768.0), 4: (np.int32, 0.0, 2147483648.0)}


#: Decoders of further formats by the file's ending: bytes and wanted rate to (mono samples, rate).
DECODERS: dict[str, Callable[[bytes, int | None], tuple[np.ndarray, int]]] = {}


def resampled(x: np.ndarray, own: int, rate: int | None) -> tuple[np.ndarray, int]:
    """Samples at another rate, linearly interpolated."""
    if not rate or rate == own or not len(x):
        return x, own
    return np.interp(np.arange(int(len(x) * rate / own)) * own / rate, np.arange(len(x)), x).astype(np.float32), rate


def decoded(path: str, raw: bytes, rate: int | None = None, decoders: dict | None = None) -> tuple[np.ndarray, int]:
    """(mono samples, rate) of a file by the decoder of its ending; an error where there is none or it fails."""
    ending = os.path.splitext(path)[1].lower()
    decode = decode_wave if ending in (".wav", ".wave") else (DECODERS if decoders is None else decoders).get(ending)
    if decode is None:
        raise RuntimeError(f"no decoder for {ending or 'files without an ending'}: {path}")
    try:
        return decode(raw, rate)
    except Exception as e:
        raise RuntimeError(f"{path} can't be decoded: {e}") from e


def decode_wave(raw: bytes, rate: int | None = None) -> tuple[np.ndarray, int]:
    """(mono samples, rate) of a wave file, resampled linearly where another rate is wanted."""
    with wave.open(io.BytesIO(raw)) as w:
        channels, width, own, n = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()
        data = w.readframes(n)
    if width not in _WIDTHS:
        raise ValueError(f"samples of {width} bytes can't be read")
    kind, zero, scale = _WIDTHS[width]
    x = ((np.frombuffer(data, dtype=kind).astype(np.float32) - zero) / scale).reshape(-1, channels).mean(axis=1)
    return resampled(x, own, rate)


def read_waves(spark: SparkSession, path: str | list[str], rate: int = 16_000, block_s: float = 30.0, decoders: dict | None = None) -> DataFrame:
    """Blocks of samples of wave files: recording (the file's stem), path, rate, from_s, samples. Files are read in
    parallel; a block is a row, so that a long recording is no one row. Other formats need one of ``decoders``, by ending."""
    extra = dict(DECODERS) | (decoders or {})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["path"], b["content"]):
                x, r = decoded(p, raw, rate, extra)
                step = int(block_s * r)
                for i in range(0, max(1, len(x)), step):
                    yield pd.DataFrame({"recording": [os.path.splitext(os.path.basename(p))[0]], "path": [p], "rate": [r], "from_s": [i / r], "samples": [x[i : i + step].tolist()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(blocks, BLOCKS)


def read_both(spark: SparkSession, path: str | list[str], rate: int, other: int, block_s: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(blocks at one rate, blocks at the other): decoded twice only where a recogniser wants another rate."""
    waves = read_waves(spark, path, rate, block_s)
    return waves, waves if other == rate else read_waves(spark, path, other, block_s)


def by_length(waves: DataFrame, threshold_s: float = 600.0) -> tuple[DataFrame, DataFrame]:
    """(blocks of recordings up to the threshold, blocks of longer ones, which are diarized chunk by chunk)."""
    length = waves.groupBy(F.col("recording").alias("_r")).agg(F.max(F.col("from_s") + F.size("samples") / F.col("rate")).alias("_len"))
    x = waves.join(length, F.col("recording").eqNullSafe(F.col("_r")))
    return tuple(x.where(c).drop("_r", "_len") for c in (F.col("_len") <= threshold_s, F.col("_len") > threshold_s))


def overlapping(waves: DataFrame, step_s: float, ahead_s: float) -> DataFrame:
    """recording, ix, from_s, samples: chunks of ``step_s`` that look ``ahead_s`` ahead, as far as there is sound.

    Each block is cut into the parts that chunks take from it, so no task holds a recording; a chunk is put together from
    its few parts.
    """
    r = F.col("rate").cast("bigint")
    step, size = F.round(F.lit(step_s) * r).cast("bigint"), F.round(F.lit(step_s + ahead_s) * r).cast("bigint")
    first = F.round(F.col("from_s") * r).cast("bigint")
    last = first + F.size("samples")
    x = waves.where(F.size("samples") > 0).withColumns({"_a": first, "_b": last, "_step": step, "_size": size})
    lo = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("_a") - F.col("_size") + 1) / F.col("_step")).cast("bigint"))
    x = x.withColumn("ix", F.explode(F.sequence(lo, F.floor((F.col("_b") - 1) / F.col("_step")).cast("bigint"))))
    begin = F.greatest(F.col("_a"), F.col("ix") * F.col("_step"))
    end = F.least(F.col("_b"), F.col("ix") * F.col("_step") + F.col("_size"))
    x = x.select("recording", "ix", (F.col("ix") * F.col("_step") / r).alias("from_s"), begin.alias("at"), F.slice("samples", (begin - F.col("_a") + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("at", "part")))
    return x.groupBy("recording", "ix", "from_s").agg(F.flatten(F.transform(parts, lambda p: p["part"])).alias("samples")).withColumn("ix", F.col("ix").cast("int"))


def sliced(samples: Column, rate: Column | int, start: Column, end: Column) -> Column:
    """The samples from start to end, both cut toward zero to whole samples."""
    r = F.lit(rate) if isinstance(rate, int) else rate
    a, b = (F.when(t >= 0, F.floor(t * r)).otherwise(F.ceil(t * r)).cast("int") for t in (start, end))
    return F.slice(samples, a + 1, F.greatest(b - a, F.lit(0)))
