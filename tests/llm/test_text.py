import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from parlance.llm import glossary_match, language, mojibake, repetition, script_form, speech

SEG = "seg_id bigint, recording string, config_id int, start_s double, end_s double, speaker int, text string, flags array<string>, received_at timestamp"


def segments(spark, texts, extra=True):
    df = spark.createDataFrame([(i, "r", 1, float(i), i + 1.0, 0, t, [], None) for i, t in enumerate(texts)], SEG)
    return df.withColumns({"form": F.lit(1), "lang": F.lit("zz"), "_src": F.lit(0)}) if extra else df


# --- scripts ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("said", "form", "kinds"),
    [
        ("Ｌ＇ａｍｉ", "L'ami", script_form.COMPAT),
        ("vériﬁé", "vérifié", script_form.COMPAT),
        ("déjà", "déjà", script_form.COMPOSED),
        ("d​﻿u", "du", script_form.INVISIBLE),
        ("de la", "de la", script_form.SPACE),
        ("ѕenhorа", "senhora", script_form.SCRIPT),
        ("enνiar", "enviar", script_form.SCRIPT),
        ("περασμέvο", "περασμένο", script_form.SCRIPT),
        ("n'а pas", "n'a pas", script_form.SCRIPT),
        ("le іѕ là", "le is là", script_form.SCRIPT),
        ("Ο συνάδελφός μου", "Ο συνάδελφός μου", 0),
        ("Москва и мир", "Москва и мир", 0),
        ("l’été – “oui”… n°2", "l’été – “oui”… n°2", 0),
        ("", "", 0),
    ],
)
def test_one_form(said, form, kinds):
    assert script_form.normalize_text(said) == (form, kinds)
    assert script_form.normalize_text(form)[1] == 0


def test_form_is_stable():
    r = random.Random(3)
    letters = "aeéocрсеоαονtk ｅ‍́'’𝐚"
    for _ in range(300):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 12)))
        for around in ("Latin", "Greek"):
            once = script_form.normalize_text(t, around)[0]
            twice = script_form.normalize_text(once, around)[0]
            assert script_form.normalize_text(twice, around)[0] == twice


def test_words_take_the_script_around_them(spark):
    rows = [(1, 7, 0, "une"), (2, 7, 1, "іѕ"), (3, 7, 2, "fin"), (4, 8, 0, "τότε"), (5, 8, 1, "Ο"), (6, 8, 2, "λόγος"), (7, 9, 0, None), (8, None, 0, "а"), (2, 7, 1, "іѕ"), (9, 7, 3, "o" * 5000)]
    w = spark.createDataFrame(rows, "word_id bigint, piece_id bigint, pos int, text string").withColumn("kinds", F.lit(9))
    got = {r.word_id: (r.form, r.kinds) for r in script_form.normalized_words(w).collect()}
    assert got[2] == ("is", script_form.SCRIPT) and got[5] == ("Ο", 0) and got[7] == (None, 0) and got[8] == ("а", 0)
    found = script_form.variants_found(w, segments(spark, [None, "", "a b", "ab"]))
    assert sorted(tuple(r) for r in found.collect()) == [("segment", 2), ("word", 2)]
    assert script_form.variants_found(w.limit(0), segments(spark, ["a"]).limit(0)).count() == 0


# --- speech -------------------------------------------------------------------------------------------------------

SPOKEN = [
    ("[00:05:17.49] SPEAKER 03 >> Le responsable", 3, 317490, "Le responsable"),
    ("(0:38.712) Locuteur n°2 : L'atelier", 2, 38712, "L'atelier"),
    ("<v Speaker 4> hum, oui", 4, None, "oui"),
    ("00:01:46,158 --> 00:01:54,726 INTERVENANTE 19 - Mmh... [rires]", 19, 106158, ""),
    ("(Speaker #7) *tousse* mm-hmm.", 7, None, ""),
    ("Avec (Chociphi) (applaudissements) la piste 3", None, None, "Avec (Chociphi) la piste 3"),
    ("The second speaker was reading.", None, None, "The second speaker was reading."),
    (None, None, None, None),
    ("", None, None, ""),
]


def test_spoken(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(SPOKEN)], "i int, t string")
    t = F.col("t")
    for r in df.select("i", speech.label_number(t).alias("n"), speech.clock_ms(t).alias("ms"), speech.spoken(t).alias("s"), speech.has_words(speech.spoken(t)).alias("w")).collect():
        _, n, ms, said = SPOKEN[r.i]
        assert (r.n, r.ms) == (n, ms)
        assert r.s == said or (not said and not r.w), SPOKEN[r.i]


# --- language -----------------------------------------------------------------------------------------------------

TEXTS = {
    "fr": "Le responsable du studio a écouté les silences trop longs. La traductrice a relu la liste des participants dans la salle.",
    "en": "The studio manager has reviewed the list of attendees. The second speaker was reading the minutes of the meeting.",
    "de": "Der Leiter des Studios hat die Liste der Gäste geprüft. Die Person am Fenster ist nicht mit dem Protokoll zufrieden.",
    "es": "El jefe del estudio ya revisó las notas de la pista. Nuestro equipo nunca escuchó los silencios muy largos.",
    "it": "Il responsabile dello studio ha già riletto gli appunti della traccia. La presidente non è più alla riunione.",
    "nl": "De baas van de studio heeft het antwoord op de vraag. Het archief wil graag een notitie bij het spoor.",
    "pl": "Kierownik studia nigdy nie słyszał tej ciszy. Przewodnicząca chce się do nas odezwać po przerwie w sali.",
    "pt": "O chefe do estúdio ainda não leu a ata da reunião. A tradutora já reviu os capítulos para uma sessão.",
    "el": "Η μεταφράστρια θέλει να δει τον κατάλογο των καλεσμένων. Ο δεύτερος ομιλητής δεν θα είναι στην αίθουσα.",
}


def test_declared():
    for label, want in (("fr-FR", "fr"), (" DEUTSCH ", "de"), ("pt_BR", "pt"), ("ell", "el"), ("und", None), ("", None), (None, None), ("unknown", None)):
        assert language.declared(label) == want


def test_wrong_labels(spark):
    rows = [(i, t, lang, "s", None) for i, (lang, t) in enumerate(TEXTS.items())]
    rows += [(20, TEXTS["en"], "fr", "s", "r"), (21, TEXTS["fr"], None, None, None), (22, TEXTS["fr"] + " " + TEXTS["en"], "fr", "s", "r"), (23, "oui non oui", None, "s", "r"), (24, None, None, "s", "r"), (25, "", "xx", "s", "r")]
    rows += [(26, "[rires] SPEAKER_3: euh oui oui oui merci merci bien fort là", "fr", "s", "r"), (27, (TEXTS["pl"] + " ") * 2000, "nl", "s", "r")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, recording string").withColumn("declared", F.lit("q"))
    c = spark.createDataFrame([(1, "German"), (1, "German")], "config_id int, lang string")
    got = {(r.src, r.row_id, r.lang) for r in language.wrong_labels(d, segments(spark, [TEXTS["es"], TEXTS["de"], None]), c).collect()}
    assert got == {("document", 20, "en"), ("document", 21, "fr"), ("document", 22, "fr"), ("document", 22, "en"), ("document", 27, "pl"), ("segment", 0, "es")}
    assert language.wrong_labels(d.limit(0), segments(spark, ["a"]).limit(0), c).count() == 0


def test_scores_by_chunks_equal_those_of_sentences(spark, data):
    """Words, stretches and scores of texts are those of a plain walk over their sentences."""
    import numpy as np

    docs = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()] + [r.text for r in spark.read.parquet(f"{data}/segments.parquet").select("text").collect()]
    docs += [None, "", " ", "Speaker 2: bonjour", "Locuteur n°2 - oui. [rires] non", "dÃ©jÃ  vu… euh, ѕenhorа", "a" * 300 + " b. c", "S 12 >> où  là\n–"]
    model = np.log(np.random.default_rng(1).random((len(language.LANGS), language.BUCKETS))).astype(np.float32)
    distinct, per_text, n_words, x = language.Scorer(model).score(docs)
    at = 0
    for t, d, k in zip(docs, distinct, per_text):
        want = [[w for w in s if not (len(w) < 8 and language._HESITATION.fullmatch(w))] for s in language.sentences(t or "")]
        want = [s for s in want if s]
        assert k == len(want) and d == len({w for s in want for w in s}) and list(n_words[at : at + k]) == list(map(len, want))
        for s, got in zip(want, x[at : at + k]):
            v = [model[:, language.features(w)].mean(axis=1) * 2.0 for w in set(s)]
            v = np.sum([y - y.max() for y in v], axis=0)
            assert np.allclose(v - v.max(), got, atol=1e-3)
        at += k
    assert at == len(x)


def test_hosts_of_any_size(spark, data, monkeypatch):
    """Priors that are sent, and priors that are joined by a shuffle but for those of large hosts, give the same."""
    tables = [spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "segments", "post_configs")]
    one = {tuple(r) for r in language.wrong_labels(*tables).select("src", "row_id", "lang").collect()}
    monkeypatch.setattr(language, "MOST_SENT", 0)
    monkeypatch.setattr(language, "HOT_SHARE", 0.02)
    assert one == {tuple(r) for r in language.wrong_labels(*tables).select("src", "row_id", "lang").collect()} and len(one) > 20


def test_language_on_held_out_text(spark, data):
    """The label of a document that is not a case is its language; of those that are told apart, nearly all agree."""
    d = spark.read.parquet(f"{data}/documents.parquet")
    rows = language.text_rows(d, spark.read.parquet(f"{data}/segments.parquet"), spark.read.parquet(f"{data}/post_configs.parquet"))
    got = language.languages(rows).where("share > 0.9 AND declared IS NOT NULL").select((F.col("lang") == F.col("declared")).cast("int").alias("same"))
    assert got.agg(F.avg("same")).first()[0] > 0.85


# --- encodings ----------------------------------------------------------------------------------------------------

CLEAN = "La déléguée régionale a déjà préparé le résumé à la mairie. Très bien, l'été dernier était gênant. Où est le café ? "


def misread(t, written, read):
    return t.encode(written).decode(read)


@pytest.mark.parametrize(("written", "read"), [("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850")])
def test_restored(spark, written, read):
    bad = CLEAN[:40] + misread(CLEAN, written, read)
    rows = [(i, CLEAN * 20) for i in range(30)] + [(100, bad), (101, None), (102, ""), (103, "no accents"), (104, "perdu � ici"), (105, misread(misread(CLEAN, "utf-8", "latin-1"), "utf-8", "latin-1")), (106, "© 2025 £15 §4 ± 3 € “x” – y")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"found": F.lit(1), "spans": F.lit(2)})
    got = {r.doc_id: r for r in mojibake.restored(d).collect()}
    assert got[100].found and got[100].restored == CLEAN[:40] + CLEAN
    assert got[105].restored == CLEAN and got[104].found and got[104].restored == "perdu � ici"
    assert not any(got[i].found for i in (0, 101, 102, 103, 106)) and got[101].restored is None
    assert mojibake.restored(d.limit(0)).count() == 0


PANGRAMS = {
    "latin": "Der König aß süße Äpfel. L'été déjà, Noël, où ça ? El niño cantó, ¿verdad? São maçãs, não é? È più città, perché. Één coördinatie, hè. ",
    "greek": "Ο λόγος της ημέρας είναι καλός, αλλά δεν έχουμε χρόνο για όλα αυτά σήμερα. ",
    "polish": "Zażółć gęślą jaźń, już świętą łódź wziął Śląsk, ponieważ mówił źle. ",
    "russian": "Съешь ещё этих мягких французских булок, да выпей чаю. ",
}


def test_share_restored_over_all_pairs(spark):
    """Each pair of encodings, on texts of each language that both can write: nine in ten come back whole."""
    sound = [t * 30 for t in PANGRAMS.values()]
    rows, meant, pairs = [(i, t) for i, t in enumerate(sound * 5)], {}, set()
    for written, read, times in mojibake.PAIRS:
        for name, t in PANGRAMS.items():
            bad = t
            try:
                for _ in range(times):
                    bad = bad.encode(written).decode(read)
            except UnicodeError:
                continue
            if bad == t or (name == "russian" and written == "cp1253"):
                continue
            i = 1000 + len(meant)
            meant[i] = t
            pairs.add((written, read, times))
            rows.append((i, bad))
    got = {r.doc_id: r for r in mojibake.restored(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not any(got[i].found for i in range(20))
    lost = [i for i, t in meant.items() if got[i].restored != t]
    assert len(pairs) >= 20 and len(lost) <= 0.1 * len(meant)


def _random_model(r, letters):
    single = {c: r.randint(1, 4000) for c in letters + " t"}
    rows = [("", c, n) for c, n in single.items()]
    rows += [(a, c, r.randint(1, single[a])) for a in single for c in letters if r.random() < 0.4]
    return mojibake.Characters(rows)


def test_gates_change_nothing():
    r = random.Random(31)
    letters = "éèàçΘΓüßÃ©‰Žłśżаб¤"
    found = looks = 0
    for _ in range(400):
        model = _random_model(r, letters)
        look = mojibake.Glance(model)
        for _ in range(5):
            t = "".join(r.choice(letters if r.random() < 0.5 else "t ttt ") for _ in range(r.randint(0, 40)))
            spans = mojibake.label(t, model, gates=False)
            assert mojibake.label(t, model) == spans
            assert look(t) or not spans
            found += bool(spans)
            looks += look(t)
    assert 50 < found < looks


def test_four_small_doubts():
    """Four characters in a row at -4.7 each that a state explains at -0.15."""
    model = mojibake.Characters([("", "t", 100_000), ("", "é", 50_000), ("", "Θ", 500), ("t", "é", 95_000), ("t", "Θ", 1000), ("Θ", "Θ", 5), ("é", "é", 47_000)])
    assert mojibake.label("tΘΘΘΘt", model, gates=False) == mojibake.label("tΘΘΘΘt", model)
    assert mojibake.Glance(model)("tΘΘΘΘt") and mojibake.restore("tΘΘΘΘt", model)[0] == "téééét"


def test_pair_counts_equal_a_plain_count():
    import pandas as pd
    from collections import Counter

    r = random.Random(32)
    texts = ["".join(r.choice("aé  ü.日'") for _ in range(r.randint(0, 30))) for _ in range(300)] + ["é" * 200 + " é", None, "", "dÃ©jÃ  é"]
    want = Counter()
    for t in texts:
        if t is not None and mojibake.looks_sound(t):
            t = t.replace("日", "一")
            want.update(("", c) for c in t)
            want.update((a, c) for a, c in zip(f" {t}", t) if not (a + c).isascii())
    got = pd.concat(mojibake.pair_counts(iter([pd.DataFrame({"text": texts[:100]}), pd.DataFrame({"text": texts[100:]})])))
    assert {(x.a, x.c): x.n for x in got.itertuples()} == dict(want)


def test_many_small_doubts_make_a_stretch():
    """Characters at -4.9 each that a state explains at -1."""
    model = mojibake.Characters([("", "t", 10_000), ("", "Θ", 1), ("", "é", 4000), ("t", "Θ", 83), ("t", "é", 4000)])
    assert -5 < model.logp("t", "Θ") < -4.7 and model.logp("t", "é") > -1.1
    new, spans = mojibake.restore("tΘtΘtΘtΘtΘ tttt \ufffd", model)
    assert new == "tétététété tttt \ufffd" and len(spans) == 2


# --- names --------------------------------------------------------------------------------------------------------

GLOSSARY = [(1, "Zicleiki", [], 1), (2, "Zicleiki Conseil", [], 2), (3, "Chociphi", ["MSGN", "Stedeauix"], 1), (4, "Fenabe-Guclè", None, 1)]


def test_names(spark):
    g = spark.createDataFrame([(i, t, t.split(), a, p) for i, t, a, p in GLOSSARY], "term_id int, term string, term_words array<string>, aliases array<string>, prio int")
    texts = ["avec ZICLEIKI CONSEIL, hier", "avec zicleikki.", "chocifi et (msgn)", "Fenabe-Gulcè là", "Fena be Guclè", "Cho euh ciphi", "rien ici", None, "", "Zicleiki Conseil et Zicleiki", "Cհocipհi".replace("հ", "h"), "x " * 3000 + "Stedeauix"]
    c = spark.createDataFrame([(1, ["Chociphi=Zicleiki", " Zicleik i Conseil ", "Zunokéfèl", "", None, '"MSGN"', "MSGM"]), (2, None)], "config_id int, glossary array<string>")
    got = sorted(tuple(r) for r in glossary_match.mapped(segments(spark, texts), c, g).select("src", "row_id", "entry_pos", "term_id").collect())
    assert [r[2:] for r in got if r[0] == "config"] == [(0, 3), (1, 2), (2, 0), (3, 0), (4, 0), (5, 3), (6, 0)]
    assert {(r[1], r[3]) for r in got if r[0] == "segment"} == {(0, 2), (1, 1), (2, 3), (3, 4), (4, 4), (5, 3), (9, 2), (9, 1), (10, 3), (11, 3)}
    assert glossary_match.mapped(segments(spark, texts), c, g.limit(0)).where("term_id <> 0").count() == 0


def test_names_of_any_length(spark):
    """Names of one letter and of four words, and one of three words with a word split."""
    g = spark.createDataFrame([(1, "Q", None), (2, "Zicleiki de la Chociphi", None), (3, "Fenabe Stedeauix Tolva", None)], "term_id int, term string, aliases array<string>")
    texts = ["le plan q est là", "avec Zicleiki de la Chociphi", "la Fena be Stedeauix Tolva", "zicleiki de la", "l'Zicleiki de la cho ciphi"]
    c = spark.createDataFrame([(1, ["q", "qq", "zicleiki de la chocifi"])], "config_id int, glossary array<string>")
    got = sorted(tuple(r) for r in glossary_match.mapped(segments(spark, texts), c, g).select("src", "row_id", "term_id").collect())
    assert got == [("config", 1, 0), ("config", 1, 1), ("config", 1, 2), ("segment", 0, 1), ("segment", 1, 2), ("segment", 2, 3), ("segment", 4, 2)]


def test_texts_are_never_the_side_that_is_sent(spark, monkeypatch):
    """Whatever the engine takes their size for: only the spellings that match are broadcast, and only while they are few."""
    g = spark.createDataFrame([(1, "Chociphi", None)], "term_id int, term string, aliases array<string>")
    c = spark.createDataFrame([(1, ["Chocifi"])], "config_id int, glossary array<string>")
    s = segments(spark, ["avec chocifi"] * 5)
    for most, wanted in ((100_000, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(glossary_match, "MOST_SENT", most)
        got = glossary_match.mapped(s, c, g).where("src = 'segment'")
        plan = got._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert len(joins) == 1 and wanted in joins[0] and "BuildLeft" not in joins[0]
        assert {r.row_id for r in got.collect()} == {0, 1, 2, 3, 4}


def test_prefix_filter_loses_nothing(spark):
    r = random.Random(7)
    names = ["".join(r.choice("abcdeioklrst") for _ in range(r.randint(6, 11))) for _ in range(40)]
    queries = []
    for n in names:
        k = r.randrange(len(n) - 1)
        queries += [n[:k] + n[k + 1] + n[k] + n[k + 2 :], n[:k] + n[k + 1 :], n[:k] + "z" + n[k:], n[:k] + "x" + n[k + 1 :]]
    q = spark.createDataFrame([(x,) for x in queries], "folded string")
    ref = spark.createDataFrame([(x,) for x in names], "folded string")
    got = {(x.q, x.r) for x in glossary_match.similar(q, ref).collect()}
    for i, n in enumerate(names):
        for x in queries[4 * i : 4 * i + 4]:
            if len(x) >= glossary_match.MIN_FUZZY:
                assert (x, n) in got


# --- repetition ---------------------------------------------------------------------------------------------------


def test_repeated_words_equal_brute_force():
    r = random.Random(5)
    for _ in range(300):
        w = [r.choice("abcd") for _ in range(r.randint(0, 25))]
        mark, seen = set(), []
        for i in range(len(w) - 2):
            if w[i : i + 3] in seen:
                mark |= {i, i + 1, i + 2}
            seen.append(w[i : i + 3])
        assert repetition.repeated_words(w) == len(mark)


def test_repeating(spark):
    normal = [f"La personne {unicodedata.name(chr(65 + i % 26))[-1]} numéro un parle {w} longuement de la piste et du {w} ce matin" for i, w in enumerate(["son", "micro", "café", "bruit", "temps"] * 60)]
    odd = ["je ne sais pas quoi dire " * 8, "non non non non non non non non non", None, "", "[...]", "a b c a b c", "mot " * 20000]
    s = segments(spark, normal + odd)
    p = spark.createDataFrame([(1, "oui je suis là " * 6), (1, "oui je suis là " * 6), (2, None)], "piece_id bigint, text string")
    got = {tuple(r) for r in repetition.repeating(p, s).collect()}
    assert got == {("segment", 300), ("segment", 301), ("segment", 306), ("piece", 1)}
    assert repetition.measured(p.limit(0), s.limit(0)).count() == 0


def partly_repeated(r, n, share):
    """n words, at least the share of them in phrases that come back after others."""
    w = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(n)]
    while repetition.repeated_words(w) < share * n:
        k = min(r.randint(3, 5), n // 2)
        i = r.randrange(n - 2 * k + 1)
        j = r.randrange(i + k, n - k + 1)
        w[j : j + k] = w[i : i + k]
    return w


def test_half_repeated_among_texts_that_repeat(spark):
    r = random.Random(1)
    usual = [partly_repeated(r, r.randint(8, 130), 0.46 * r.random()) for _ in range(300)]
    words = usual + [partly_repeated(r, n, 0.5) for n in range(8, 131, 3)]
    p = spark.createDataFrame([], "piece_id bigint, text string")
    got = {x.row_id for x in repetition.repeating(p, segments(spark, [" ".join(w) for w in words])).collect()}
    assert got == {i for i, w in enumerate(words) if repetition.repeated_words(w) * 2 >= len(w)} and len(got) >= 41


def test_stratum_spoilt_by_loops(spark):
    """Loops below the centre of a stratum of loops are beyond the source's estimate, on the side of more."""
    r = random.Random(2)
    usual = ["le " + " ".join(partly_repeated(r, 20, 0)) for _ in range(1500)]
    loops = [" ".join(partly_repeated(r, 4, 0) * r.randint(8, 12)) for _ in range(190)]  # no frequent word: stratum 'none'
    milder = [" ".join(partly_repeated(r, 11, 0) + partly_repeated(r, 3, 0) * 5) for _ in range(20)]
    p = spark.createDataFrame([], "piece_id bigint, text string")
    got = {x.row_id: x for x in repetition.measured(p, segments(spark, usual + loops + milder)).collect()}
    assert {got[i].lang for i in range(1500, 1710)} == {"none"}
    assert all(got[i].outlier for i in range(1500, 1710)) and not any(got[i].outlier for i in range(1500))


def test_mcd_ignores_outliers():
    import numpy as np

    r = np.random.default_rng(1)
    x = np.vstack([r.normal(0, 1, (300, 4)), r.normal(20, 1, (60, 4))])
    m, c = repetition.mcd(x, np.ones(len(x)))
    assert np.abs(m).max() < 0.5 and np.linalg.det(c) < 5
