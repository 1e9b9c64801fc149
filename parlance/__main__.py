"""Command line: stored turns and a recogniser's pieces to transcripts.

    python -m parlance --turns TURNS --pieces PIECES [--words WORDS] -o FOLDER

TURNS, PIECES and WORDS are Parquet tables as in ``sources.models``; on a cluster, run it with spark-submit.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import pipeline, post
from .session import local_session, tidy, written
from .sources import models, sinks


def options(argv: list[str]) -> argparse.Namespace:
    """The options, checked before any work starts."""
    p = argparse.ArgumentParser(prog="parlance", description="Speaker-attributed transcripts from stored turns and pieces.")
    p.add_argument("--turns", required=True)
    p.add_argument("--pieces", required=True)
    p.add_argument("--words", help="an aligner's words; without them words are spread evenly")
    p.add_argument("-o", "--output-dir", required=True)
    p.add_argument("-f", "--formats", default="txt,srt,json")
    p.add_argument("--asr", choices=sorted(models.HYPOTHESIS_SOURCES), default="cohere", help="what gave the pieces")
    p.add_argument("-l", "--lang", choices=pipeline.LANGS, default="fr")
    p.add_argument("-c", "--context", help="names and terms, as given to the recogniser")
    p.add_argument("-g", "--glossary", help="terms parted by commas, 'Term' or 'Term=alias|alias'; the context by default")
    p.add_argument("--style", choices=("verbatim", "lu"), default="verbatim")
    p.add_argument("--numbers", choices=("keep", "digits"), default="keep")
    p.add_argument("--no-typography", action="store_true")
    p.add_argument("--no-lang-filter", action="store_true")
    p.add_argument("--mode", choices=("window", "turns"), default="window")
    p.add_argument("--keep-tags", action="store_true")
    p.add_argument("--max-chunk", type=float, default=30.0)
    p.add_argument("--max-wps", type=float, default=6.0)
    p.add_argument("--master", help="a Spark master for a local run, such as local[8]")
    got = p.parse_args(argv)
    try:
        got.formats = sinks.check_formats([f for x in got.formats.split(",") if (f := x.strip())])
        models.limits(got.asr, got.context)
        got.pipeline = pipeline.Options(lang=got.lang, keep_tags=got.keep_tags, max_chunk=got.max_chunk, max_wps=got.max_wps)
        got.post = post.PostConfig(
            lang=got.lang, lang_filter=not got.no_lang_filter, glossary=post.parse_glossary(got.glossary, got.context), style=got.style, numbers=got.numbers, typography=not got.no_typography
        )
    except ValueError as e:
        p.error(str(e))
    return got


def transcripts(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """recording, format, part, path, n_segments of the files that were written."""
    turns, pieces = spark.read.parquet(o.turns), spark.read.parquet(o.pieces)
    if o.mode == "window":
        words = spark.read.parquet(o.words) if o.words else None
        segments = pipeline.window_segments(pieces, turns, words, o.pipeline)
    else:
        spans = turns.select("recording", F.col("ord").alias("span_id"), "speaker", "start_s", "end_s")
        segments = pipeline.turn_segments(spans, pieces, o.pipeline)
    done = post.kept(post.postprocess(written(segments, "segments"), o.post)).select(*segments.columns)
    return written(sinks.write_files(done.withColumn("speaker", F.col("label")), o.output_dir, o.formats), "files")


def main(argv: list[str] | None = None) -> int:
    o = options(sys.argv[1:] if argv is None else argv)
    spark = local_session(o.master.removeprefix("local[").rstrip("]")) if o.master else SparkSession.builder.appName("parlance").getOrCreate()
    n = transcripts(spark, o).agg(F.count("*").alias("files"), F.countDistinct("recording").alias("recordings")).first()
    print(f"{n['files']} files of {n['recordings']} recordings in {o.output_dir}")
    tidy(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
