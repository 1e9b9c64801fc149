import datetime
import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import mixing, nearest_time, packing, speaker_turns, tokens

SEG = "seg_id bigint, recording string, config_id int, start_s double, end_s double, speaker int, text string, flags array<string>, received_at timestamp"


def test_clean_turns(spark):
    rows = [
        (5, "r", 1, 9.0, 9.5, None, "fin", ["b"], None),
        (1, "r", 1, 0.0, 1.0, 4, "Bonjour", ["a"], None),
        (2, "r", 1, 1.0, 2.0, None, "SPEAKER_4: euh, merci", None, None),
        (3, "r", 1, 2.0, 3.0, None, "S2: [rires]", [], None),
        (4, "r", 1, None, None, None, "[00:00:05.50] suite", ["b", "a"], None),
        (1, "r", 1, 0.0, 1.0, 4, "Bonjour", ["a"], datetime.datetime(2025, 1, 1)),
        (6, None, 1, 1.0, 1.0, None, "x", [], None),
        (7, "r", 1, 9.0, 9.5, None, None, [], None),
        (8, "r", 1, 9.0, 9.5, 2, "", [], None),
    ]
    df = spark.createDataFrame(rows, SEG).withColumns({"head": F.lit(1), "known": F.lit(2), "_bucket": F.lit(3)})
    for width in (1000, 900_000):
        got = {(r.recording, r.speaker, r.first_seg_id, r.last_seg_id, r.text, tuple(r.flags)) for r in speaker_turns.clean_turns(df, width).collect()}
        assert got == {("r", 4, 1, 2, "Bonjour merci", ("a",)), ("r", 2, 4, 5, "suite fin", ("a", "b")), (None, None, 6, 6, "x", ())}
    assert speaker_turns.clean_turns(df.limit(0)).count() == 0


def test_turns_equal_the_walk(spark, data):
    df = spark.read.parquet(f"{data}/segments.parquet")
    rows = speaker_turns.rows_with_speakers(df).select("recording", "seg_id", "start_ms", "said").toPandas()
    base = df.dropDuplicates(["seg_id"]).select("seg_id", F.coalesce("speaker", speaker_turns.label_number(F.col("text"))).alias("k")).toPandas().set_index("seg_id")["k"]
    want = set()
    for rec, g in rows.sort_values(["recording", "start_ms", "seg_id"]).groupby("recording"):
        now, cur = None, None
        for x in g.itertuples():
            k = base[x.seg_id]
            now = now if k != k or k is None else int(k)
            if not any(c.isalnum() for c in x.said or ""):
                continue
            if cur and cur[1] == now:
                cur[3] = x.seg_id
            else:
                want |= {tuple(cur)} if cur else set()
                cur = [rec, now, x.seg_id, x.seg_id]
        want |= {tuple(cur)} if cur else set()
    got = {tuple(r) for r in speaker_turns.clean_turns(df, 20_000).select("recording", "speaker", "first_seg_id", "last_seg_id").collect()}
    assert got == want


def test_the_decoder_decides_where_labels_do_not(spark):
    """What a forward fill of known speakers can't give: rows before a first label, and columns and labels at odds."""
    rows = [
        (1, "a", 1, 0.0, 1.0, None, "le micro de la piste", [], None), (2, "a", 1, 1.1, 2.0, None, "piste du micro", [], None), (3, "a", 1, 2.1, 3.0, 7, "le micro", [], None),
        (1 + 10, "b", 1, 0.0, 1.0, None, "bonjour", [], None), (2 + 10, "b", 1, 9.0, 10.0, 7, "le micro", [], None),
        (1 + 20, "c", 1, 0.0, 1.0, 5, "la piste du micro", [], None), (2 + 20, "c", 1, 1.1, 2.0, 8, "SPEAKER_5: la piste du micro", [], None), (3 + 20, "c", 1, 9.0, 9.5, 8, "studio", [], None),
        (1 + 30, "d", 1, 0.0, 1.0, 5, "bonjour", [], None), (2 + 30, "d", 1, 9.0, 9.5, 5, "SPEAKER_8: la piste du micro", [], None), (3 + 30, "d", 1, 9.6, 10.0, 8, "la piste du micro", [], None),
        (1 + 40, "e", 1, 0.0, 1.0, 9, "SPEAKER_3: un", [], None),
    ]
    got = {(r.recording, r.speaker, r.first_seg_id, r.last_seg_id) for r in speaker_turns.clean_turns(spark.createDataFrame(rows, SEG)).collect()}
    assert got == {("a", 7, 1, 3), ("b", None, 11, 11), ("b", 7, 12, 12), ("c", 5, 21, 22), ("c", 8, 23, 23), ("d", 5, 31, 31), ("d", 8, 32, 33), ("e", 3, 41, 41)}


def test_decoding_equals_search():
    """All segmentations and speakers of few rows, labels with weights that nothing outweighs."""
    import numpy as np

    r = random.Random(6)
    go = math.log(1 - 1 / speaker_turns.MEAN_ROWS)
    opening = speaker_turns.OPEN + math.log(1 / speaker_turns.MEAN_ROWS)
    for _ in range(150):
        n, head = r.randint(1, 5), r.choice([None, 1])
        follows = head is not None or r.random() < 0.3
        named = [frozenset(r.sample([1, 2, 3], r.choice([0, 0, 1, 1, 2]))) for _ in range(n)]
        gaps, shared = np.array([r.choice([0.0, 1.3, 4.1]) for _ in range(n)]), np.array([r.random() for _ in range(n)])
        link = speaker_turns.PAUSE * np.minimum(gaps, 10) + speaker_turns.LEXICAL * shared
        best = -np.inf
        for cuts in itertools.product([False, True], repeat=n - 1):
            begins = [0, *(k + 1 for k, c in enumerate(cuts) if c), n]
            turns = list(zip(begins, begins[1:]))
            if any(i and not named[i] for i, _ in turns):
                continue  # a turn opens at a named row
            for who in itertools.product([None, 1, 2, 3], repeat=len(turns)):
                v = 0.0
                for (i, j), s in zip(turns, who):
                    goes_on = not i and follows and s == head
                    if any(x and s not in x for x in named[i:j]) or (s is not None and not goes_on and not any(named[i:j])):
                        v = -np.inf
                    elif not i and follows and head is not None and not named[0] and not goes_on:
                        v = -np.inf
                    else:
                        start = link[0] + go if goes_on and (not named[0] or link[0] + go > opening) else opening
                        v += (opening if i else start) + sum(link[i + 1 : j]) + (j - i - 1) * go
                best = max(best, v)
        speakers, part = speaker_turns.decode(named, gaps, shared, head, follows)
        assert abs(sum(part) - best) < 1e-9
        assert all(not x or s in x for x, s in zip(named, speakers))


def test_turns_have_the_score_of_the_best_path(spark):
    """Exhaustive search over the openings that labels leave free, whatever the buckets."""
    r = random.Random(4)
    known = [r.choice([1, 1, 2, None, None]) for _ in range(12)]
    starts = [i * 1.0 + r.choice([0.0, 0.5]) for i in range(12)]
    words = [[r.choice(["micro", "piste", "temps", "studio"]) for _ in range(3)] for _ in range(12)]
    df = spark.createDataFrame([(i, "r", 1, starts[i], starts[i] + r.choice([0.1, 1.0]), known[i], " ".join(words[i]), [], None) for i in range(12)], SEG)
    ends = [x.end_s for x in df.orderBy("seg_id").collect()]
    now, reign = None, []
    for k in known:
        now = now if k is None else k
        reign.append(now)
    free = [i for i in range(1, 12) if known[i] is not None and reign[i] == reign[i - 1]]
    best = None
    for pick in range(1 << len(free)):
        opens = {0} | {i for i in range(1, 12) if reign[i] != reign[i - 1]} | {x for k, x in enumerate(free) if pick >> k & 1}
        part = []
        for i in range(12):
            gap = max(0.0, starts[i] - ends[i - 1]) if i else 0.0
            link = speaker_turns.PAUSE * gap + speaker_turns.LEXICAL * (len(set(words[i]) & set(words[i - 1])) / len(set(words[i])) if i else 0)
            part.append(speaker_turns.OPEN + math.log(0.5) if i in opens else link + math.log(0.5))
        if best is None or sum(part) > sum(best):
            best = part
    firsts = [i for i in range(12) if not i or reign[i] != reign[i - 1]] + [12]
    want = {a: round(sum(best[a:b]), 6) for a, b in zip(firsts, firsts[1:])}
    for width in (1000, 3000, 900_000):
        assert {x.first_seg_id: round(x.score, 6) for x in speaker_turns.clean_turns(df, width).collect()} == want


def write(spark, path, name, rows, ddl):
    df = spark.createDataFrame(rows, ddl).withColumns({"side": F.lit(1), "stretch": F.lit("x")})
    df.repartition(2).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return f"{path}/{name}.parquet"


W = "word_id bigint, recording string, start_s double, end_s double, speaker int, received_at timestamp"
T = "turn_id bigint, recording string, start_s double, end_s double, speaker int, received_at timestamp"


def test_nearest_equals_brute_force(spark, tmp_path):
    r = random.Random(9)
    now = datetime.datetime(2025, 3, 1)
    seen = lambda: r.choice([None, now, now + datetime.timedelta(days=r.randint(0, 9))])
    ts = [(i + 1, r.choice(["a", "b", None]), round(a := r.uniform(0, 3000), 3), round(a + r.choice([-1, 0, 3, 9, 2000]) * r.random(), 3), r.choice([0, 1, None]), seen()) for i in range(120)]
    ws = [(i + 1, r.choice(["a", "b", None]), round(a := r.uniform(-2, 3100), 3), round(a + r.choice([0, 0.3]), 3), r.choice([0, 1, None]), seen()) for i in range(800)]
    ts += [(500, "a", 1.0, 1e12, 1, now), (501, "a", float("nan"), 2.0, 1, now), ts[0], (502, "c", 10.0, 11.0, 0, now), (503, "c", 10.0, 11.0, 0, now)]
    ws += [ws[0], (900, "c", 12.0, 12.0, 0, now), (901, "c", None, 12.0, 0, now), (902, "c", 12.2, 12.202, 0, now), (903, "d", 1.0, 1.2, 0, now), (904, "c", 8.8, 8.8, 0, now)]
    got = {(x.word_id, x.turn_id) for x in nearest_time.nearest_time(spark, write(spark, tmp_path, "words", ws, W), write(spark, tmp_path, "turns", ts, T)).collect()}
    ms = lambda x: math.floor(x * 1000 + 0.5)
    want = set()
    for i, rec, s, e, sp, _ in ws:
        if None in (rec, s, e, sp):
            continue
        m = ms(s) + ms(e)
        ds = [(max(2 * ms(a) - m, m - 2 * ms(b), 0), k) for k, q, a, b, p, _ in ts if q == rec and p == sp and a == a and b < 1e6 and ms(b) > ms(a)]
        if not ds or min(ds)[0] > 2400:
            want.add((i, None))
        elif min(ds)[0] > 0:
            want.add((i, min(ds)[1]))
    assert got == want


@pytest.mark.parametrize("parts", [1, 3])
def test_nearest_at_former_limits(spark, tmp_path, parts):
    """Times beyond 25 days, turns longer than a day, and words far inside such turns."""
    now = datetime.datetime(2025, 3, 1)
    day = lambda d: now + datetime.timedelta(days=d)
    far = 2_147_483_648 / 1000 + 5000.0
    ts = [(1, "a", far, far + 3.0, 0, day(0)), (2, "a", 0.0, 4e6, 1, day(1)), (3, "b", 1e12, 1e12 + 1, 0, day(30)), (4, "c", 0.0, 9e4, 0, day(60)), (5, "c", 1e5, 3e5, 0, day(61))]
    ws = [(1, "a", far + 3.5, far + 3.6, 0, day(0)), (2, "a", 2e6, 2e6 + 1, 1, day(2)), (3, "a", 4e6 + 0.5, 4e6 + 0.6, 1, day(2)), (4, "a", 4e6 + 9, 4e6 + 9, 1, day(2)), (5, "b", 1e12 - 0.5, 1e12 - 0.5, 0, day(33)), (6, "c", 95_000.0, 95_000.0, 0, day(60)), (7, "c", 2e5, 2e5, 0, day(60)), (8, "c", 299_999.0, 299_999.0, 0, day(60))]
    got = {(x.word_id, x.turn_id) for x in nearest_time.nearest_time(spark, write(spark, tmp_path, "words", ws, W), write(spark, tmp_path, "turns", ts, T), parts=parts).collect()}
    assert got == {(1, 1), (3, 2), (4, None), (5, 3), (6, None)}


def test_state_shrinks_as_the_replay_goes(spark, tmp_path):
    now = datetime.datetime(2025, 3, 1)
    r = random.Random(10)
    rows = [(i, f"r{i // 20}", 10.0 * (i % 20), 10.0 * (i % 20) + 1.0, 0, now + datetime.timedelta(days=i // 20, hours=r.randint(0, 30))) for i in range(4000)]
    ws = [(i, rec, a + 2.0, a + 2.2, s, t) for i, rec, a, _, s, t in rows]
    words, turns = write(spark, tmp_path, "words", ws, W), write(spark, tmp_path, "turns", rows, T)
    seen = []
    got = {(x.word_id, x.turn_id) for x in nearest_time.nearest_time(spark, words, turns, progress=seen).collect()}
    assert got == {(i, i) for i in range(4000)}
    marks = [p.eventTime["watermark"] for batch in seen for p in batch if "watermark" in p.eventTime]
    assert len(seen) == 4 and len(set(marks)) >= 4 and marks == sorted(marks)
    left = [batch[-1].stateOperators[0].numRowsTotal for batch in seen]
    assert max(left[:-1]) < 60 and left[-1] <= 2  # of 200 recordings, those of the last days; in the end the marker alone
    assert {(x.word_id, x.turn_id) for x in nearest_time.nearest_time(spark, words, turns, parts=1).collect()} == got


def test_nearest_emits_as_the_watermark_goes(spark, tmp_path):
    at = lambda d: datetime.datetime(2025, 3, 1) + datetime.timedelta(days=d)
    left, right = [f"{tmp_path}/{x}" for x in ("l", "r")]
    steps = [([(1, "a", 10.0, 10.2, 0, at(0))], [(1, "a", 11.0, 12.0, 0, at(0))]), ([(2, "a", 13.0, 13.0, 0, at(1))], [(2, "a", 8.0, 9.9, 0, at(1))]), ([(3, "a", 50.0, 50.0, 0, at(40))], [(3, "b", 1.0, 2.0, 0, at(40))]), ([(4, "a", 60.0, 60.0, 0, at(41))], [])]
    out = []
    for w, t in steps:
        spark.createDataFrame(w, W).write.mode("append").parquet(left)
        spark.createDataFrame(t, T).write.mode("append").parquet(right)
        s = nearest_time.nearest_time_stream(spark.readStream.schema(W).parquet(left), spark.readStream.schema(T).parquet(right), lateness="14 days")
        s.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        out.append({(x.word_id, x.turn_id) for x in spark.read.schema(s.schema).parquet(f"{tmp_path}/o").collect()})
    assert out[1] == set()  # a turn may still come
    assert out[3] == {(1, 2), (2, 1)}  # turn 2 came a day late and was nearer; words 3 and 4 still wait


def test_nearest_of_empty_tables(spark, tmp_path):
    w, t = write(spark, tmp_path, "w", [], W), write(spark, tmp_path, "t", [], T)
    assert nearest_time.nearest_time(spark, w, t).count() == 0


# --- sizes in tokens ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_sizes_equal_the_tokenizer(name):
    path = os.path.join(os.path.dirname(tokens.TOKENIZER), name)
    r = random.Random(15)
    parts = ["mot", "l'été", "we'll", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\x1c", "\x85", "…", "12", ".", "<|endoftext|>", "日本", "\u200b", "é", "🙂", "-", "'s"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    texts += ["", " ", "  ", " a", "a ", "a  b", "a   b", "x" * 3000 + " y", "mot " * 5000]
    t = tokens._load(path)
    assert tokens.count(texts, path) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert (tokens._sizes(path) is not None) == (name == "byte_bpe_50k.json")


# --- containers ---------------------------------------------------------------------------------------------------


def bins(runs, capacity):
    n, used = 0, {}
    for count, content in runs:
        assert sum(s * k for s, k in content) <= capacity
        n += count
        for s, k in content:
            used[s] = used.get(s, 0) + k * count
    return n, used


def least(items, capacity):
    """The least number of bins, by search."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in rooms[:k]:
                go(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


def test_packing_plan():
    r = random.Random(11)
    for _ in range(150):
        capacity = r.randint(5, 30)
        items = [r.randint(1, capacity) for _ in range(r.randint(0, 9))]
        counts = {s: items.count(s) for s in items}
        n, used = bins(packing.plan(counts, capacity), capacity)
        assert used == counts and n <= least(items, capacity) + 1
        assert bins(packing.fullest_bins(counts, capacity), capacity)[1] == counts
        fixed, rest = packing.reduce_dominated(counts, capacity)
        left = [s for s, k in rest.items() for _ in range(k)]
        assert bins(fixed, capacity)[0] + least(left, capacity) == least(items, capacity)  # reduction costs nothing


def test_three_small_items_beside_the_largest():
    counts = {10: 1, 7: 2, 4: 1, 3: 3}
    assert least([10, 7, 7, 4, 3, 3, 3], 19) == 2 == bins(packing.plan(counts, 19), 19)[0]
    fixed, rest = packing.reduce_dominated({9: 1, 6: 1, 5: 1}, 20)
    assert (fixed, rest) == ([(1, [(9, 1), (6, 1), (5, 1)])], {})


@pytest.mark.parametrize("capacity", range(4, 13))
def test_reduction_costs_nothing_in_any_small_instance(capacity):
    """All multisets of up to six items (five of the larger capacities)."""
    known = {}

    def fewest(items):
        if items not in known:
            known[items] = least(items, capacity)
        return known[items]

    for n in range(1, 7 if capacity < 9 else 6):
        for items in itertools.combinations_with_replacement(range(1, capacity + 1), n):
            fixed, rest = packing.reduce_dominated({s: items.count(s) for s in items}, capacity)
            assert bins(fixed, capacity)[0] + fewest(tuple(s for s in sorted(rest) for _ in range(rest[s]))) == fewest(items)


def test_reduction_costs_nothing_in_many_instances():
    r = random.Random(21)
    for _ in range(4000):
        capacity = r.randint(5, 20)
        items = [r.randint(1, r.choice([capacity, capacity // 2])) for _ in range(8)]
        fixed, rest = packing.reduce_dominated({s: items.count(s) for s in items}, capacity)
        assert bins(fixed, capacity)[0] + least([s for s, k in rest.items() for _ in range(k)], capacity) == least(items, capacity)


def test_best_fit_on_counts_equals_item_by_item():
    r = random.Random(12)
    for _ in range(100):
        capacity = r.randint(5, 40)
        items = sorted((r.randint(1, capacity) for _ in range(r.randint(0, 60))), reverse=True)
        rooms = []
        for s in items:
            fit = [x for x in rooms if x >= s]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - s)
            else:
                rooms.append(capacity - s)
        assert bins(packing.best_fit({s: items.count(s) for s in items}, capacity), capacity)[0] == len(rooms)


def documents(spark, texts):
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(texts)], "doc_id bigint, text string, source string")
    return df.withColumns({"size": F.lit(1), "tokens": F.lit("x"), "container": F.lit(0)})


def test_packed(spark):
    r = random.Random(13)
    texts = [("mot " * r.choice([1, 5, 5, 5, 40, 90, 300]), "s") for _ in range(200)] + [(None, "s"), ("", "s")]
    d = documents(spark, texts)
    kinds = spark.createDataFrame([("s", 64), ("m", 200), ("s", 64), ("none", 0)], "container string, capacity_tokens int")
    got = packing.packed(d, kinds).toPandas()
    size = dict(enumerate(tokens.count([t or "" for t, _ in texts])))
    for kind, capacity in (("s", 64), ("m", 200)):
        g = got[(got.container == kind) & got.bin_id.notna()]
        assert g.groupby("bin_id").tokens.sum().max() <= capacity
        assert g.groupby("doc_id").tokens.sum().to_dict() == {k: n for k, n in size.items() if n}
        assert all(len(p) == -(-size[k] // capacity) for k, p in g.groupby("doc_id").part)
        assert set(g.bin_id) == set(range(int(g.bin_id.max()) + 1))
    assert got.bin_id.isna().sum() == 6
    rep = {x.container: x for x in packing.report(packing.packed(d, kinds), kinds).collect()}
    assert rep["m"].bins <= rep["m"].least_bins * 1.1 + 1
    assert packing.packed(d.limit(0), kinds).count() == 0


# --- mixing -------------------------------------------------------------------------------------------------------


def test_water_filling():
    q = mixing.fill([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 9), ("d", 0.5, 3)], {"a": 10, "b": 100, "c": 100}, 100)
    assert q["a"] == 10 and abs(q["b"] - 54) < 1e-9 and abs(q["c"] - 36) < 1e-9 and q["d"] == 0
    assert mixing.fill([("a", 1.0, 2)], {"a": 10}, 100) == {"a": 20.0}
    assert mixing.fill([("a", 0.0, 2)], {"a": 10}) == {"a": 0.0}


@pytest.mark.parametrize("sent", [100_000, 0])
def test_mixed(spark, monkeypatch, sent):
    monkeypatch.setattr(mixing, "MOST_SENT", sent)
    monkeypatch.setattr(mixing, "BIN_DOCS", 40)
    r = random.Random(14)
    texts = [("mot " * r.randint(1, 60), r.choice(["a", "a", "a", "b", "c", None])) for _ in range(600)] + [(None, "a"), ("", "b")]
    d = documents(spark, texts)
    t = spark.createDataFrame([("m", "a", 0.3, 1), ("m", "b", 0.6, 3), ("m", "z", 0.1, 3), ("n", "c", 1.0, 1)], "mix string, source string, target_share double, max_repeats int")
    got = mixing.mixed(d, t)
    rows = got.collect()
    most = {("m", "a"): 1, ("m", "b"): 3, ("n", "c"): 1}
    assert all(0 < x.repeats <= most[x.mix, x.source] for x in rows)
    size = dict(enumerate(tokens.count([x or "" for x, _ in texts])))
    total = {s: sum(size[i] for i, (_, q) in enumerate(texts) if q == s) for s in "abc"}
    want = mixing.fill([("a", 0.3, 1), ("b", 0.6, 3), ("z", 0.1, 3)], total)
    for s in "ab":
        have = sum(x.tokens * x.repeats for x in rows if (x.mix, x.source) == ("m", s))
        assert want[s] - 70 <= have <= want[s] + 1
    assert [tuple(x) for x in mixing.mixed(d.repartition(5), t).orderBy("mix", "source", "doc_id").collect()] == sorted(tuple(x) for x in rows)
    rep = {(x.mix, x.source): x for x in mixing.shares(got, t).collect()}
    assert rep["m", "z"].tokens == 0 and abs(sum(x.actual_share for k, x in rep.items() if k[0] == "m") - 1) < 1e-4
    assert mixing.mixed(d.limit(0), t).count() == 0
