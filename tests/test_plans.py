import importlib
import json
import os
import sys
import wave
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance.plans import metrics, pipeline, post, queries
from parlance.sources import audio, models, sinks
from parlance.streaming import stateful


def plain(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return round(float(v), 6) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)

    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    got, want = queries.QUERIES[name](spark, data).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


#: Queries that SQL can't express (compression, glossary with counts, numbers in texts): what their rows must hold.
SOUND = {
    "t3_glossary": "hits <> '' AND text IS NOT NULL",
    "t10_numbers": "text LIKE '%21, 97 et 200' AND numbers >= 3",
    "t12_postprocess": "text = trim(text) AND fillers >= 0 AND NOT text LIKE '%  %'",
    "a10_post_summary": "segments_in > 0 AND glossary > 0 AND fillers > 0 AND stutters > 0 AND typography > 0",
    "l4_compression": "ratio > 0 AND ratio < 40",
    "l6_diagnose": "issues IS NOT NULL",
    "l8_retry_ladder": "(flags = '' AND rung = 0) OR (flags = 'retry' AND rung > 0) OR flags LIKE 'loop_trimmed; %'",
    "j6_pending": "span_id IS NOT NULL",
    "c6_align_words": "end_s >= start_s AND text <> ''",
    "e1_word_gap": "edits <= longest AND gap BETWEEN 0 AND 1",
    "e2_agreement": "edits <= words AND system_a < system_b",
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql(spark, data, name):
    got = queries.QUERIES[name](spark, data).cache()
    assert got.count() > 0 and got.where(f"NOT coalesce({SOUND[name]}, false)").count() == 0
    keys = {"l8_retry_ladder": ["recording", "span_id"], "l4_compression": ["piece_id"], "l6_diagnose": ["recording", "span_id", "rung"], "t12_postprocess": ["seg_id"]}.get(name)
    assert keys is None or got.select(keys).distinct().count() == got.count()
    got.unpersist()


def test_tidy(spark):
    from parlance import session

    df = session.written(spark.range(3), "kept")
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(path) and session.tidy(spark) >= 1 and not os.path.exists(path) and session.tidy(spark) == 0


def test_entry_without_the_optional_subpackage(monkeypatch):
    for m in [m for m in sys.modules if m == "__spark_entry__" or m.startswith("parlance.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "parlance.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries.QUERIES)
    sys.modules.pop("__spark_entry__")


SEG = "recording string, seg_id bigint, start_s double, end_s double, speaker int, text string, flags array<string>"


def test_postprocess(spark):
    rows = [
        ("r", 1, 0.0, 1.0, 0, "Euh, je je vois Bousar ?", []),
        ("r", 2, 1.0, 2.0, 0, "this is clearly another language", []),
        ("r", 3, 2.0, 3.0, 0, "euh", []),
        ("r", 4, 3.0, 4.0, 0, None, None),
        ("r", 5, 4.0, 5.0, 0, "dix ans", []),
    ]
    conf = F.when(F.col("seg_id") == 2, F.create_map(F.lit("en"), F.lit(0.95))).otherwise(F.create_map(F.lit("fr"), F.lit(0.9)))
    s = spark.createDataFrame(rows, SEG).withColumn("confidence", conf)
    done = post.postprocess(s, post.PostConfig(glossary=("Boussard",), style="lu", numbers="digits"))
    got = {r.seg_id: r.text for r in post.kept(done).collect()}
    assert got == {1: "Je vois Boussard\u202f?", 5: "10 ans"}
    n = post.summary(done).first()
    assert (n.segments_in, n.dropped_language, n.empty, n.glossary, n.fillers, n.stutters, n.numbers) == (5, 1, 2, 1, 2, 1, 1)
    assert post.glossary_counts(done).first()["hit"] == "bousar -> Boussard"
    assert post.parse_glossary(None, "A, B=x|y") == ("A", "B=x|y")
    with pytest.raises(ValueError):
        post.PostConfig(style="x")


def test_sinks(spark, tmp_path):
    rows = [("a/b", 1, 0.0, 1.0005, 0, "oui", []), ("a/b", 2, 1.0, 62.5, 1, "non", ["loop_trimmed"]), ("c", 3, 0.0, 1.0, 2, "é", None), ("c", 4, None, 1.0, 2, "x", None)]
    s = spark.createDataFrame(rows, SEG)
    done = sinks.write_files(s, str(tmp_path), ["txt", "srt", "json"]).collect()
    assert len(done) == 6
    assert (tmp_path / "a%2Fb.txt").read_text() == "[00:00:00.00 - 00:00:01.00] SPEAKER_0: oui\n[00:00:01.00 - 00:01:02.50] SPEAKER_1 ⚠: non\n"
    assert (tmp_path / "a%2Fb.srt").read_text().startswith("1\n00:00:00,000 --> 00:00:01,000\n[SPEAKER_0] oui\n\n2\n")
    assert json.loads((tmp_path / "c.json").read_text())[0]["text"] == "é"
    with pytest.raises(ValueError):
        sinks.check_formats(["doc"])
    many = spark.createDataFrame([("long", i, float(i), i + 0.5, 0, f"t{i}", []) for i in range(10)], SEG)
    parts = sinks.write_files(many, f"file://{tmp_path}/parts", ["srt", "txt"], most=4).cache()
    assert sorted((r.format, r.part, r.n_segments) for r in parts.collect()) == [(f, k, n) for f in ("srt", "txt") for k, n in ((0, 4), (1, 4), (2, 2))]
    assert (tmp_path / "parts" / "long.1.srt").read_text().startswith("5\n00:00:04,000")
    whole = {r.format: r.content for r in sinks.read_files(parts).collect()}
    assert whole["txt"].splitlines() == [f"[{sinks.clock(i)} - {sinks.clock(i + 0.5)}] SPEAKER_0: t{i}" for i in range(10)]
    sinks.write_table(s.where("start_s IS NOT NULL"), str(tmp_path / "t"), "parquet")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_waves(spark, tmp_path):
    x = (np.sin(np.arange(16000 * 2) / 20) * 20000).astype(np.int16)
    with wave.open(str(tmp_path / "one.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(x.tobytes())
    b = audio.read_waves(spark, str(tmp_path / "*.wav"), block_s=0.5).orderBy("from_s").collect()
    assert len(b) == 4 and b[0].recording == "one" and len(b[0].samples) == 8000 and b[3].from_s == 1.5
    d = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0],)], "s array<float>")
    assert d.select(audio.sliced(F.col("s"), 10, F.lit(0.19), F.lit(0.49))).first()[0] == [1.0, 2.0, 3.0]


def test_models(spark):
    with pytest.raises(ValueError):
        models.limits("nobody")
    with pytest.raises(ValueError):
        models.limits("cohere", "names")
    with pytest.raises(ValueError):
        models.check_aligner("ja")
    assert models.limits("whisper-fr").longest_s == 30.0
    a = spark.createDataFrame([("r", 1, 0, "x"), ("r", 1, 1, "y"), ("r", 2, 0, "z")], "recording string, span_id bigint, rung int, text string")
    diagnose = lambda d: d.withColumn("issues", F.when(F.col("text") == "x", F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")))
    got = models.with_ladder(models.Stored(a), a.select("recording", "span_id").distinct(), 2, diagnose)
    assert sorted(r.text for r in got.collect()) == ["x", "y", "z"]


def test_generated_tokens(spark):
    d = spark.createDataFrame([([1, 2, 3, 4], 2), ([1], 3)], "t array<int>, n int")
    for source, want in (("cohere", [[3, 4], []]), ("whisper-fr", [[1, 2, 3, 4], [1]])):
        assert [r[0] for r in d.select(models.generated(F.col("t"), F.col("n"), source)).collect()] == want


def test_command_line(spark, tmp_path, capsys):
    from parlance.__main__ import options, transcripts

    base = ["--turns", f"{tmp_path}/t", "--pieces", f"{tmp_path}/p", "-o", f"{tmp_path}/o"]
    for bad in (["-f", "doc"], ["-l", "xx"], ["--max-chunk", "36"], ["-c", "names"], ["--mode", "x"]):
        with pytest.raises(SystemExit):
            options([*base, *bad])
    o = options([*base, "-c", "Boussard", "--asr", "whisper-fr", "--style", "lu"])
    assert o.post.glossary == ("Boussard",) and o.formats == ["txt", "srt", "json"]
    spark.createDataFrame([("r", 0, 0.0, 4.0, 5), ("r", 1, 4.0, 8.0, 6)], "recording string, ord bigint, start_s double, end_s double, speaker int").write.parquet(f"{tmp_path}/t")
    rows = [(1, "r", 0, 0, 0.0, 4.0, "Euh, monsieur Bousard est là.", []), (2, "r", 1, 0, 4.0, 8.0, "Oui, je le vois.", [])]
    spark.createDataFrame(rows, "piece_id bigint, recording string, span_id bigint, piece_ix int, start_s double, end_s double, text string, flags array<string>").write.parquet(f"{tmp_path}/p")
    for mode in ("window", "turns"):
        o = options([*base, "-g", "Boussard", "--style", "lu", "--mode", mode, "-f", "txt"])
        assert transcripts(spark, o).count() == 1
        assert (tmp_path / "o" / "r.txt").read_text() == "[00:00:00.00 - 00:00:04.00] SPEAKER_0: Monsieur Boussard est là.\n[00:00:04.00 - 00:00:08.00] SPEAKER_1: Oui, je le vois.\n"


def test_metrics(spark):
    p = spark.createDataFrame([("dix ans euh passés", "10 ans passé"), (None, "")], "text_a string, text_b string")
    assert [(r.edits, r.longest) for r in metrics.word_gap(p).collect()] == [(1, 3), (0, 0)]
    t = spark.createDataFrame([("u", "a", "x y"), ("u", "b", "x z"), ("u", "c", "q")], "unit string, system string, text string")
    assert {(r.system_a, r.system_b): r.edits for r in metrics.agreement(t, ["a", "b"]).collect()} == {("a", "b"): 1}


def test_turn_segments(spark):
    spans = spark.createDataFrame([("r", 1, 5, 0.0, 2.0), ("r", 2, 3, 3.0, 4.0)], "recording string, span_id bigint, speaker int, start_s double, end_s double")
    p = spark.createDataFrame([("r", 1, 1, 0.0, 2.0, "b", ["x"]), ("r", 1, 0, 0.0, 2.0, "a", None), ("r", 2, 0, 3.0, 3.5, "merci", [])], "recording string, span_id bigint, piece_ix int, start_s double, end_s double, text string, flags array<string>")
    got = pipeline.turn_segments(spans, p).collect()
    assert [(r.text, r.label, r.flags) for r in got] == [("a b", 0, ["x"])]
    with pytest.raises(ValueError):
        pipeline.Options(max_chunk=40)


def run(spark, stream, path):
    q = stream.writeStream.format("parquet").option("path", f"{path}/o").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/o").collect()


def test_all_common_words_are_protected(spark, tmp_path):
    from parlance.plans import queries

    words = [f"mot{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}" for i in range(2500)]
    text = " ".join(["le"] * 50_000 + words + words[:1500])
    spark.createDataFrame([(1, text)], "piece_id bigint, text string").write.parquet(f"{tmp_path}/pieces.parquet")
    spark.createDataFrame([(1, "Chociphi", None)], "term_id int, term string, aliases array<string>").write.parquet(f"{tmp_path}/glossary.parquet")
    often = queries._config(spark, str(tmp_path)).frequencies
    assert set(often) == {"le", *words} and min(often.values()) < 5.3


def test_tokens_follow_the_frames(spark, tmp_path):
    from parlance.plans import queries

    rows = [(i, 1, [float((i * 7 + k * 3) % 5) for k in range(64)]) for i in range(90)] + [(90, 2, [0.0] * 64)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.span_id: (r.n, r.frames) for r in queries.spans_of_frames(spark, str(tmp_path)).select("span_id", F.size("tokens").alias("n"), F.size("logp").alias("frames")).collect()}
    assert got == {1: (30, 90), 2: (1, 1)}
    assert queries.QUERIES["c4_align_tokens"](spark, str(tmp_path)).where("span_id = 1").count() == 30


def test_watch_loops(spark, tmp_path):
    rows = [("r", 1, i, i % 2) for i in range(60)] + [("r", 2, i, i) for i in range(60)] + [("r", 3, i, 99) for i in range(60)]
    spark.createDataFrame(rows, "recording string, span_id bigint, ix int, token int").repartition(3).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("recording string, span_id bigint, ix int, token int").option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in")
    got = run(spark, stateful.watch_loops(s, ignore=(99,)), tmp_path)
    assert [(r.span_id, r.generated, r.reason) for r in got] == [(1, 20, "token loop (period=2, x10)")]


def test_watch_loops_of_words(spark, tmp_path):
    """Two words said eight times: too few for the check of tokens, enough for that of words."""
    from parlance.plans import queries

    rows = [(1, "r", "oui non " * 8), (2, "r", "un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize")]
    spark.createDataFrame([(i, r, t.strip()) for i, r, t in rows], "piece_id bigint, recording string, text string").write.parquet(f"{tmp_path}/pieces.parquet")
    got = queries.QUERIES["l5_watch_loops"](spark, str(tmp_path)).collect()
    assert [(r.span_id, r.generated, r.reason) for r in got] == [(1, 16, "text loop (period=2 words, x8)")]


def test_chunked_turns(spark, tmp_path):
    ddl = "recording string, ix int, from_s double, samples array<float>"
    spark.createDataFrame([("r", i, float(i), [float(i)] * 3) for i in (2, 0, 1)], ddl).repartition(3).write.parquet(f"{tmp_path}/in")

    def model(x, cache):
        n = int(cache or b"0") + 1
        return [(0.0, 1.0, n)], str(n).encode()

    s = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert sorted((r.start_s, r.speaker) for r in run(spark, stateful.chunked_turns(s, model), tmp_path)) == [(0.0, 1), (1.0, 2), (2.0, 3)]


def test_speech_sessions(spark, tmp_path):
    ddl = "recording string, speaker int, ts timestamp, seconds double"
    at = lambda s: datetime(2025, 1, 1) + timedelta(seconds=s)
    rows = [("r", 0, at(0), 2.0), ("r", 0, at(2.5), 1.0), ("r", 0, at(9), 1.0), ("q", 0, at(5), 0.81), ("q", 0, at(5.1), 0.1), ("z", 0, at(86400), 1.0)]
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
    got = run(spark, stateful.speech_sessions(s), tmp_path)
    assert sorted((r.n_turns, (r.to_ts - r.from_ts).total_seconds()) for r in got) == [(1, 1.0), (2, 0.81), (2, 3.5)]


class Loops(models.HypothesisModel):
    """Says the words in a span, but goes in circles on spans longer than ``upto`` seconds, and on the first rung beyond half of that."""

    def __init__(self, words, upto):
        self.words, self.upto, self.limits, self.asked = words, upto, models.limits("cohere"), []

    def attempts(self, spans, rung):
        self.asked.append(rung)
        mid = (F.col("w.start_s") + F.col("w.end_s")) / 2
        met = spans.alias("s").join(self.words.alias("w"), (F.col("s.recording") == F.col("w.recording")) & (mid >= F.col("s.start_s")) & (mid < F.col("s.end_s")), "left")
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("w.start_s"), F.col("w.text")))), lambda x: x["text"]), " ")
        keys = [F.col(f"s.{c}") for c in ("recording", "span_id", "node", "start_s", "end_s")]
        long = F.col("end_s") - F.col("start_s")
        circles = (long > self.upto) | (F.lit(rung == 0) & (long > self.upto / 2))
        x = met.groupBy(*keys).agg(text.alias("text")).withColumn("text", F.when(circles, F.concat("text", F.repeat(F.lit(" encore"), 9))).otherwise(F.col("text")))
        return x.withColumns({"rung": F.lit(rung), "hit_limit": F.lit(False), "stop_reason": F.lit(None).cast("string")})


WORDS = "recording string, start_s double, end_s double, text string"


def test_spans_are_halved_and_tried_again(spark):
    """Solved at once, by a retry, only after a split, after two, and not at all."""
    words = spark.createDataFrame([("r", i + 0.1, i + 0.4, f"mot{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)], WORDS)
    spans = spark.createDataFrame([("r", 1, 0.0, 3.0), ("r", 2, 10.0, 17.0), ("r", 3, 20.0, 32.0), ("r", 4, 40.0, 68.0), ("r", 5, 100.0, 160.0), ("r", 6, 170.0, 170.1)], "recording string, span_id bigint, start_s double, end_s double")
    model = Loops(words, 8.0)
    got = pipeline.transcribed(model, spans, pipeline.Options(lang=None)).orderBy("span_id", "piece_ix").collect()
    rows = [(r.span_id, r.piece_ix, r.start_s, r.end_s, len(r.text.split()), r.flags[:1]) for r in got]
    assert rows[:2] == [(1, 0, 0.0, 3.0, 3, []), (2, 0, 10.0, 17.0, 7, ["retry"])]
    assert rows[2:4] == [(3, 0, 20.0, 26.0, 6, ["retry"]), (3, 1, 26.0, 32.0, 6, ["retry"])]
    assert rows[4:8] == [(4, k, 40.0 + 7 * k, 47.0 + 7 * k, 7, ["retry"]) for k in range(4)]
    assert [r[:4] + r[5:] for r in rows[8:]] == [(5, k, 100.0 + 15 * k, 115.0 + 15 * k, ["loop_trimmed"]) for k in range(4)]
    assert all(r.text.endswith(" encore") and r.text.count("encore") <= 2 for r in got[8:]) and model.asked == [0, 1, 2] * 3


@pytest.mark.parametrize("mode", ["window", "turns"])
def test_run_from_turns_to_files(spark, tmp_path, mode):
    words = spark.createDataFrame([("r", i * 0.5, i * 0.5 + 0.4, w) for i, w in enumerate(("Bonjour , euh , je vois dix ans . " * 8).split())], WORDS)
    turns = spark.createDataFrame([("r", 1, 0.0, 15.9, 4), ("r", 2, 16.2, 32.0, 7), ("r", 3, 40.0, 40.1, 9)], "recording string, ord bigint, start_s double, end_s double, speaker int")
    config = post.PostConfig(style="lu", numbers="digits", lang_filter=False)
    t = np.arange(64 * 45) % 64
    waves = spark.createDataFrame([("r", 64, 15.0 * k, np.where(t[: 64 * 15] < 60, 1.0, 0.0).astype(float).tolist()) for k in range(3)], "recording string, rate int, from_s double, samples array<float>")
    got = pipeline.run(turns, Loops(words, 20.0), pipeline.Options(), mode, waves=waves, config=config, folder=str(tmp_path), formats=["txt", "json"]).orderBy("start_s").collect()
    assert {(r.speaker, r.label) for r in got} == {(4, 0), (7, 1)} and all("10 ans" in r.text and "euh" not in r.text for r in got)
    assert len((tmp_path / "r.txt").read_text().splitlines()) == len(got) == len(json.loads((tmp_path / "r.json").read_text()))
    with pytest.raises(ValueError):
        pipeline.run(turns, Loops(words, 20.0), mode="x")
    with pytest.raises(ValueError):
        pipeline.run(turns, Loops(words, 20.0), formats=["doc"])


def test_decoders_and_rates(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(bytes(range(100)))
    with pytest.raises(RuntimeError):
        audio.decoded("a.raw", b"")
    with pytest.raises(RuntimeError):
        audio.decoded("a.wav", b"no wave")
    plug = {".raw": lambda raw, rate: audio.resampled(np.frombuffer(raw, np.uint8).astype(np.float32), 50, rate)}
    assert audio.read_waves(spark, str(tmp_path / "a.raw"), 25, decoders=plug).first().samples == [float(x) for x in range(0, 100, 2)]
    audio.DECODERS.update(plug)
    try:
        one, two = audio.read_both(spark, str(tmp_path / "a.raw"), 50, 100)
        assert (one.first().rate, two.first().rate, len(two.first().samples)) == (50, 100, 200)
        assert audio.read_both(spark, str(tmp_path / "a.raw"), 50, 50)[0].first().rate == 50
    finally:
        audio.DECODERS.clear()


@pytest.mark.parametrize(("step", "ahead", "block"), [(1.0, 0.5, 7), (0.3, 1.2, 4), (5.0, 0.0, 100), (2.0, 3.0, 3)])
def test_overlapping_chunks(spark, step, ahead, block):
    x = [float(i) for i in range(37)]
    waves = spark.createDataFrame([("r", 10, i / 10, x[i : i + block]) for i in range(0, 37, block)] + [("s", 10, 0.0, [])], "recording string, rate int, from_s double, samples array<float>")
    got = [(r.ix, r.from_s, r.samples) for r in audio.overlapping(waves, step, ahead).orderBy("ix").collect()]
    n, size = round(step * 10), round((step + ahead) * 10)
    assert got == [(k, k * n / 10, x[k * n : k * n + size]) for k in range(-(-37 // n))]
    short, long = audio.by_length(waves, 3.7)
    assert short.count() == waves.count() and long.count() == 0 and audio.by_length(waves, 3.6)[1].select("recording").distinct().count() == 1


def test_fusion_of_two_recognisers(spark):
    from dataclasses import replace

    from parlance.operators import fusion

    a, b = models.limits("cohere"), models.limits("whisper-fr")
    assert fusion.fused_limits(a, b).longest_s == 30.0
    for args in ((a, models.limits("vibevoice")), (a, b, 8000)):
        with pytest.raises(ValueError):
            fusion.fused_limits(*args)
    assert replace(a, batch=1).batch == 1
    ddl = "recording string, span_id bigint, piece_ix int, text string, flags array<string>"
    one = spark.createDataFrame([("r", 1, 1, "chat", ["x"]), ("r", 1, 0, "le", None), ("r", 2, 0, "seul", [])], ddl)
    two = spark.createDataFrame([("r", 1, 0, "le chien", ["y"]), ("r", 3, 0, "autre", [])], ddl)
    vocab = {c: i for i, c in enumerate("|abcdefghijklmnopqrstuvwxyz", 1)}
    said = "|".join("le chien".split())
    frames = [("r", 1, k, [0.0 if i == vocab[c] else -20.0 for i in range(28)]) for k, c in enumerate(said)]
    e = spark.createDataFrame(frames, "recording string, span_id bigint, frame int, logp array<double>")
    got = {r.span_id: r for r in fusion.fused(fusion.pairs_of(one, two, e), vocab, vocab["|"]).collect()}
    assert (got[1].text, got[1].flags, got[1].secondary_chosen) == ("le chien", ["x", "y"], 1) and got[2].text == "seul" and 3 not in got
    assert "1 from the second" in fusion.summary_line(got[1].asDict())
    assert post.summary_line({"segments_in": 3, "empty": 0}) == "3 segments_in"


def test_functions_from_sql(spark):
    from parlance.functions.arrow import register

    assert "collapse_loops" in register(spark)
    spark.createDataFrame([("oui " * 9 + "dix ans",)], "t string").createOrReplaceTempView("said")
    r = spark.sql("SELECT collapse_loops(t) AS a, french_numbers(t).text AS b, clock_time(61.5D) AS c, measure_text(t, 0.1D) AS d FROM said").first()
    assert (r.a, r.b[-6:], r.c, r.d) == ("oui oui dix ans", "10 ans", "00:01:01.50", ["110.0 words/s", "repeated 1-gram x9"])
