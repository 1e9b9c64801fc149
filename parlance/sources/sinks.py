"""Transcripts as text, subtitles and JSON: a row a line, and a file a recording."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock, clock_udf, srt_clock
from ..operators.intervals import numbered


def text_line(start: Column, end: Column, speaker: Column, text: Column, flags: Column) -> Column:
    """[from - to] SPEAKER_n: text, with a warning sign where a loop was cut."""
    warn = F.when(F.coalesce(F.array_contains(flags, "loop_trimmed"), F.lit(False)), " ⚠").otherwise("")
    return F.concat(F.lit("["), clock_udf(start), F.lit(" - "), clock_udf(end), F.lit("] SPEAKER_"), speaker.cast("string"), warn, F.lit(": "), text)


def srt_block(index: Column, start: Column, end: Column, speaker: Column, text: Column) -> Column:
    """One subtitle."""
    return F.concat(index.cast("string"), F.lit("\n"), srt_clock(start), F.lit(" --> "), srt_clock(end), F.lit("\n[SPEAKER_"), speaker.cast("string"), F.lit("] "), text, F.lit("\n"))


def json_row(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _srt_clock(t: float) -> str:
    ms = round(t * 1000)
    return f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


def to_txt(rows: list[dict], first: int = 0) -> str:
    return "".join(f"[{clock(r['start'])} - {clock(r['end'])}] SPEAKER_{r['speaker']}{' ⚠' if 'loop_trimmed' in r['flags'] else ''}: {r['text']}\n" for r in rows) or "\n"


def to_srt(rows: list[dict], first: int = 0) -> str:
    return "\n".join(f"{i}\n{_srt_clock(r['start'])} --> {_srt_clock(r['end'])}\n[SPEAKER_{r['speaker']}] {r['text']}\n" for i, r in enumerate(rows, first + 1))


def to_json(rows: list[dict], first: int = 0) -> str:
    return json.dumps(rows, ensure_ascii=False, indent=2)


#: The text of a file from its rows and the number of segments before them.
WRITERS: dict[str, Callable[[list[dict], int], str]] = {"txt": to_txt, "srt": to_srt, "json": to_json}


def check_formats(formats: list[str]) -> list[str]:
    """The formats, or an error before any work starts."""
    if unknown := [f for f in formats if f not in WRITERS]:
        raise ValueError(f"unknown formats: {', '.join(unknown)}; known: {', '.join(WRITERS)}")
    return formats


#: Segments of one file; a longer recording goes on in further files.
FILE_SEGMENTS = 50_000

_WRITTEN = "recording string, format string, part int, path string, n_segments bigint"


def write_files(segments: DataFrame, folder: str, formats: list[str], most: int = FILE_SEGMENTS) -> DataFrame:
    """A file a recording and format in ``folder``, a path or address of any file system that Arrow reaches from the
    executors; recording, format, part, path, n_segments.

    segments: recording, start_s, end_s, speaker, text, flags, and seg_id or none. Files are named by recording, so that
    two recordings never share one; a task retried writes the same file again. No task holds more than ``most`` segments
    of a recording: the files after the first have their number before the ending, and subtitles are counted on.
    """
    check_formats(formats)
    ident = "seg_id" if "seg_id" in segments.columns else "text"
    kept = segments.where(F.col("start_s").isNotNull() & F.col("end_s").isNotNull() & F.col("speaker").isNotNull() & F.col("text").isNotNull())
    kept = numbered(kept.select("recording", "start_s", "end_s", "speaker", "text", "flags", *([ident] if ident != "text" else [])), ["recording"], ["start_s", "end_s", ident], "ix")

    def write(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        system.create_dir(root, recursive=True)
        g = g.sort_values("ix")
        first, part = int(g["ix"].iloc[0]), int(key[1])
        rows = [
            {"start": float(a), "end": float(b), "speaker": int(s), "text": t, "flags": [] if f is None else list(f)}
            for a, b, s, t, f in zip(g["start_s"], g["end_s"], g["speaker"], g["text"], g["flags"])
        ]
        out = []
        for f in formats:
            name = quote(str(key[0]), safe="") + (f".{part}" if part else "") + f".{f}"
            made = f"{root}/{name}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(made) as file:
                file.write(WRITERS[f](rows, first).encode("utf-8", "surrogatepass"))
            system.move(made, f"{root}/{name}")
            out.append((key[0], f, part, f"{folder}/{name}", len(rows)))
        return pd.DataFrame(out, columns=["recording", "format", "part", "path", "n_segments"])

    parts = kept.withColumn("_part", F.floor(F.col("ix") / most).cast("int"))
    return parts.groupBy("recording", "_part").applyInPandas(write, _WRITTEN)


def read_files(done: DataFrame) -> DataFrame:
    """recording, format, content of the files that ``write_files`` tells of, parts put together."""
    first = done.select("path").first()
    if first is None:
        return done.select("recording", "format", F.lit("").alias("content"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    files = done.sparkSession.read.format("binaryFile").load(first["path"].rsplit("/", 1)[0]).select(name(F.url_decode("path")).alias("_name"), F.decode("content", "UTF-8").alias("content"))
    x = done.withColumn("_name", name(F.url_decode("path"))).join(files, "_name")
    parts = F.sort_array(F.collect_list(F.struct("part", "content")))
    return x.groupBy("recording", "format").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "").alias("content"))


def write_table(segments: DataFrame, path: str, fmt: str = "json") -> None:
    """The segments as Spark writes them, a folder a recording: for transcripts too large for single files."""
    w = segments.repartition("recording").sortWithinPartitions("recording", "start_s").write.mode("overwrite").partitionBy("recording")
    w.json(path) if fmt == "json" else w.parquet(path)


