"""The language of each document and segment, and of each stretch of a mixed text, by Bayesian evidence fusion.

Evidence of a stretch (a sentence): the likelihood of its words under hashed models of words and letter triples, fitted
on labelled rows; the label declared for the row (with its region tag), through a matrix of how labels and languages
go together; and the prior of its host, smoothed from the text to its recording, source and the whole table, from grouped counts.
Rows have no web address here, so an address suffix gives no evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain
from operator import or_
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import mojibake
from .script_form import normalize_text
from .speech import HESITATIONS, LABEL_WORDS, ROUND_NOTES

LANGS = ("de", "el", "en", "es", "fr", "it", "nl", "pl", "pt")
# Codes and names of the languages.
NAMES = {
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "tedesco", "duits", "niemiecki", "alemão"),
    "el": ("el", "ell", "gre", "greek", "ελληνικά", "ελληνικα", "grec", "griego", "greco", "grieks", "griechisch", "grecki", "grego", "gr"),
    "en": ("en", "eng", "english", "anglais", "inglés", "inglese", "engels", "englisch", "angielski", "inglês"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "espagnol", "spagnolo", "spaans", "spanisch", "hiszpański", "espanhol"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "francés", "francese", "frans", "französisch", "francuski", "francês"),
    "it": ("it", "ita", "italian", "italiano", "italien", "italiaans", "italienisch", "włoski"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "néerlandais", "holandés", "olandese", "niederländisch", "holenderski", "neerlandês", "flemish", "vlaams"),
    "pl": ("pl", "pol", "polish", "polski", "polonais", "polaco", "polacco", "pools", "polnisch", "polonês"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugais", "portugués", "portoghese", "portugees", "portugiesisch", "portugalski"),
}
# Frequent words of each language.
SEEDS = {
    "de": "der die das und ist nicht ein eine mit für auf den dem des noch hat wegen",
    "el": "και το την του της τον στο στην για με δεν θα είναι από η ο",
    "en": "the and of to is was with for not that has will did should because since those",
    "es": "el la los las y que en con una por para nunca muy desde está del ya",
    "fr": "le la les des du une et est pas pour dans avec sans très cette a depuis",
    "it": "il lo gli che della del dei con per non è alla nella più di ha prima",
    "nl": "de het een en van niet met voor heeft bij op in om dat die zou wil",
    "pl": "i w na nie się z do od jest tę po przed ale że oraz przez już",
    "pt": "o os as da do das dos não com uma para em mais ainda já está sem",
}
#: Size of the hashed model; rows it is fitted on, at most (by the order of a hash of their id).
BUCKETS, SAMPLE_ROWS = 1 << 15, 8_000
#: Weight of the text's log likelihood, of a label, and of a parent in the smoothing of host priors.
TEMPER, LABEL_WEIGHT, SMOOTH, TEXT_SMOOTH = 0.5, 0.5, 8.0, 2.0
#: Hosts' priors up to which all are sent to every task. Of more, those of hosts with more than this part of all rows
#: are sent, which are fewer than the part's inverse, and the others are joined by a shuffle.
MOST_SENT, HOT_SHARE = 10_000, 0.001
MIN_WORDS, MIN_SHARE = 6, 0.1

_WORD = re.compile(r"[^\W\d_]+")
_OPENING, _CLOSING = re.compile(r"[\[(*<](?!\d)"), frozenset((":", ">", ")", "]"))
_SHAPE = str.maketrans("123456789", "0" * 9)
_STOP = re.compile(r"[.!?…;\n–]+")
_NOTE = re.compile(rf"\[[^\]\d]{{0,60}}\]|\*[^*\d]{{1,60}}\*|<[^<>\d]{{1,60}}>|\((?:{'|'.join(ROUND_NOTES)})\)", re.I)
#: The number of a speaker's label, and no time of day.
_NUMBER = re.compile(r"(?<![\d:.,])\d{1,6}\s?(?:>>|[:\])>](?!\d)|-(?=\s))")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_LABELS = frozenset(LABEL_WORDS)
_HESITATION = re.compile("|".join(HESITATIONS))
#: Characters that need another look: look-alikes, variants and invisible ones lie outside these ranges.
_UNUSUAL = re.compile(r"[^\x00-\x7F¡-§©«-¬®-±¶-·»¿-ıĴ-ľŁ-ňŊ-žΆΈ-ΊΌΎ-ΡΣ-ώ‐-―‘-‟…€£�]")
_NAME_OF = {n: lang for lang, names in NAMES.items() for n in names}
_SEED_OF = {w: lang for lang in LANGS for w in SEEDS[lang].split()}
for _w in {w for w in _SEED_OF if sum(w in SEEDS[x].split() for x in LANGS) > 1}:
    del _SEED_OF[_w]


def declared(label: str | None) -> str | None:
    """The language a label names, in any code, region tag or name; None where it names none of the known ones."""
    if label is None or not (s := label.strip().lower()):
        return None
    return _NAME_OF.get(s) or _NAME_OF.get(re.split(r"[-_ (]", s)[0])


def label_language(label: Column) -> Column:
    """``declared`` as a column expression; '?' where a label names some other language, null where it is missing."""
    s = F.trim(F.lower(label))
    head = F.element_at(F.split(s, r"[-_ (]"), 1)
    out = F.lit(None).cast("string")
    for lang in LANGS:
        out = F.when(s.isin(*NAMES[lang]) | head.isin(*NAMES[lang]), F.lit(lang)).otherwise(out)
    return out


def without_labels(text: str) -> str:
    """Text without sound notes, and without the words of speaker labels, which stand before their numbers."""
    if not ("[" in text or "(" in text or "*" in text or "<" in text or ":" in text or " - " in text or ">>" in text):
        return text
    text = _NOTE.sub(" ", text)
    out, at = [], 0
    for m in _NUMBER.finditer(text):
        begin = max(at, m.start() - 24)
        words = _NOT_LETTERS.split(text[begin : m.start()].lower())
        w = words[-1] or (words[-2] if len(words) > 1 else "")
        if w in ("n", "no", "nr"):  # "Locuteur n°2"
            w = words[-3] if not words[-1] and len(words) > 2 else words[-2] if words[-1] and len(words) > 1 else ""
        if w in _LABELS:
            out.append(text[at : begin + text[begin : m.start()].lower().rfind(w)])
            at = m.end()
    return "".join(out) + text[at:] if out else text


def sentences(text: str) -> list[list[str]]:
    """The words of each stretch between sentence ends, lower-cased, for text that may be garbled or dressed up.
    Hesitations are still among them."""
    return [w for s in _STOP.split(without_labels(plain_text(text)).lower()) if (w := _WORD.findall(s))]


def plain_text(text: str) -> str:
    """Text without garbling that shows by itself, in the one form of its characters."""
    if not text.isascii():
        if mojibake.suspicious(text):
            text = mojibake.undress(text)
        if _UNUSUAL.search(text):
            text = normalize_text(text)[0]
    return text


def features(word: str) -> list[int]:
    w = f"^{word}$"
    out = [crc32(w.encode()) % BUCKETS]
    out += [crc32(("3" + w[i : i + 3]).encode()) % BUCKETS for i in range(len(w) - 2)]
    return out


def _fit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Feature counts by language, of sentences whose frequent words speak for the declared language."""
    words: list[Counter] = [Counter() for _ in LANGS]
    for b in batches:
        for text, lang in zip(b["text"], b["declared"]):
            stretches = sentences(text or "")
            votes = [[_SEED_OF[w] for w in s if w in _SEED_OF] for s in stretches]
            mine, every = sum(v.count(lang) for v in votes), sum(map(len, votes))
            for s, v in zip(stretches, votes):
                # A stretch that says nothing itself follows its text, where that is of one language.
                if v.count(lang) * 2 > len(v) if v else mine >= 2 and mine >= 0.9 * every:
                    words[LANGS.index(lang)].update(s)
    n = np.zeros((len(LANGS), BUCKETS))
    for k, c in enumerate(words):
        for w, m in c.items():
            np.add.at(n[k], features(w), m)
    k, f = np.nonzero(n)
    yield pd.DataFrame({"lang": k.astype("int32"), "feature": f.astype("int32"), "n": n[k, f]})


def fit(rows: DataFrame) -> np.ndarray:
    """Log probabilities (language, feature) from labelled rows. Its size is fixed."""
    labelled = rows.where(F.col("declared").isNotNull()).withColumn("_h", F.xxhash64("_src", "_id"))
    # The hash up to which rows are taken: ids are sorted, not texts.
    upto = labelled.select("_h").distinct().orderBy("_h").limit(SAMPLE_ROWS).agg(F.max("_h")).first()[0]
    sample = labelled.where(F.col("_h") <= F.lit(upto)).dropDuplicates(["_src", "_id"]).select("text", "declared")
    counts = np.zeros((len(LANGS), BUCKETS))
    for r in sample.mapInPandas(_fit_batches, "lang int, feature int, n double").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"], r["feature"]] = r["n"]
    for k, lang in enumerate(LANGS):
        for w in SEEDS[lang].split():
            np.add.at(counts[k], features(w), 20)
    counts += 0.3
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


_VECTOR = [f"v{k}" for k in range(len(LANGS))]
_SCORED = "_src string, _id bigint, _host1 string, _host2 string, declared string, n_distinct int, n_words binary, scores binary, " + ", ".join(f"{v} float" for v in _VECTOR)


def _different(x: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Scorer:
    """Text log likelihoods of stretches under a fitted model; words it has met, and chunks between spaces, are kept."""

    #: What a chunk may ask of its text: another look at its characters; a search for notes and labels, by itself or
    #: where it has a word of labels and another chunk (or the same) what may stand after their number.
    LOOK, NOTE, WORD, MARK = 1, 2, 4, 8
    #: Words kept, and words summed at once.
    MOST, HELD = 500_000, 200_000

    def __init__(self, model: np.ndarray):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        """Rare words of a long partition need not be kept."""
        self.ids: dict[str, int] = {}
        self.kinds: dict[str, int] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.shapes: dict[str, tuple[int, tuple[int, ...]]] = {}
        self.chars = 0
        self.table = np.zeros((1024, len(LANGS)))

    def word(self, w: str) -> int:
        if (i := self.ids.get(w)) is not None:
            return i
        if len(w) < 8 and _HESITATION.fullmatch(w):
            i = -1
        else:
            i = 1 + len(self.ids)
            while i >= len(self.table):
                self.table = np.vstack([self.table, np.zeros_like(self.table)])
            v = self.model[:, features(w)].mean(axis=1) * 2.0
            self.table[i] = v - v.max()
        self.ids[w] = i
        return i

    def _asks(self, chunk: str) -> int:
        marked = chunk[:1] in _CLOSING or (chunk[:1] == "-" and not chunk[1:2].strip()) or _NUMBER.search(chunk + " ")
        return (self.NOTE if _OPENING.search(chunk) else 0) | (self.MARK if marked else 0)

    def _learn(self, chunks: Iterable[str]) -> None:
        for c in chunks:
            self.chars += len(c)
            if c.isascii() and c.upper() == c.lower():  # numbers and times: few are alike, but their shapes are
                if (known := self.shapes.get(shape := c.translate(_SHAPE))) is None:
                    known = self.shapes[shape] = (self._asks(c), (0,) if _STOP.search(c) else ())
                self.kinds[c], self.parts[c] = known
                continue
            kind = self._asks(c) | (0 if _LABELS.isdisjoint(_NOT_LETTERS.split(c.lower())) else self.WORD)
            if not c.isascii() and (_UNUSUAL.search(c) or mojibake.suspicious(c)):
                kind |= self.LOOK
            out: list[int] = []
            for k, stretch in enumerate(_STOP.split(c.lower())):
                if k:
                    out.append(0)
                out += [i for w in _WORD.findall(stretch) if (i := self.word(w)) > 0]
            self.kinds[c], self.parts[c] = kind, tuple(out)

    def _chunks(self, text: str) -> list[str]:
        """The chunks of a text, without labels and notes, in the one form of its characters."""
        chunks, asked = self._known(text)
        if asked & self.LOOK:
            # No misread sequence goes across a space: the chunks that hold some are put right, and stay as many.
            odd = [k for k, c in enumerate(chunks) if self.kinds[c] & self.LOOK]
            right = " ".join(chunks[k] for k in odd)
            right = mojibake.undress(right) if mojibake.suspicious(right) else right
            for k, c in zip(odd, right.split(" ")):
                chunks[k] = c
            text = " ".join(chunks)
            text = normalize_text(text)[0] if _UNUSUAL.search(right) else text
            chunks, asked = self._known(text)
        if asked & self.NOTE or asked & (self.WORD | self.MARK) == self.WORD | self.MARK:
            if (plain := without_labels(text)) != text:
                chunks, _ = self._known(plain)
        return chunks

    def _known(self, text: str) -> tuple[list[str], int]:
        chunks = (text.replace("\n", " \n ") if "\n" in text else text).split(" ")
        try:
            kinds = set(map(self.kinds.__getitem__, chunks))
        except KeyError:
            self._learn(set(chunks).difference(self.kinds))
            kinds = set(map(self.kinds.__getitem__, chunks))
        return chunks, reduce(or_, kinds)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text its different words and its stretches; per stretch its words and its scores by language."""
        got: list[tuple[np.ndarray, ...]] = []
        flat: list[int] = []
        ends: list[int] = []
        for t in texts:
            if t:
                flat.extend(chain.from_iterable(map(self.parts.__getitem__, self._chunks(t))))
                flat.append(0)
            ends.append(len(flat))
            if len(flat) > self.HELD or len(self.ids) > self.MOST or self.chars > 100 * self.MOST:
                got.append(self._sums(flat, ends))
                flat, ends = [], []
                if len(self.ids) > self.MOST or self.chars > 100 * self.MOST:
                    self._forget()
        got.append(self._sums(flat, ends))
        return tuple(np.concatenate(x) for x in zip(*got))

    def _sums(self, flat: list[int], ends: list[int]) -> tuple[np.ndarray, ...]:
        at = np.asarray(flat, dtype=np.int64)
        upto = np.asarray(ends, dtype=np.int64)
        words = at > 0
        stretch = np.cumsum(~words)[words]
        n = np.bincount(stretch, minlength=1)
        numbers = np.flatnonzero(n)  # stretches with words
        # "no, no, no" tells as much as "no".
        keys = _different(stretch << 32 | at[words])
        own, which = keys >> 32, keys & 0xFFFFFFFF
        starts = np.searchsorted(own, numbers)
        x = np.add.reduceat(self.table[which], starts, axis=0) if len(numbers) else np.zeros((0, len(LANGS)))
        # The text of each stretch: texts end with a zero, so a stretch belongs to the first text that ends after it.
        last = np.cumsum(~words)[upto - 1] if len(flat) else np.zeros(len(upto), dtype=np.int64)
        last = np.where(upto > 0, last, 0)
        text = np.searchsorted(last, numbers + 1)
        per_text = np.bincount(text, minlength=len(upto))
        distinct = np.bincount(_different(np.searchsorted(last, own + 1) << 32 | which) >> 32, minlength=len(upto))
        x = x - x.max(axis=1, keepdims=True) if len(x) else x
        return distinct, per_text, n[numbers].astype(np.int32), x.astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def evidence(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """Text log likelihoods of each row's stretches, packed, and the words of each row by their likely language."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            distinct, per_text, n_words, x = scorer.score(b["text"].tolist())
            at = np.concatenate([[0], np.cumsum(per_text)]).astype(int)
            soft = _softmax(TEMPER * x) * n_words[:, None] if len(x) else x
            d = b[["_src", "_id", "_host1", "_host2", "declared"]].copy()
            d["n_distinct"] = distinct
            packed = x.astype(np.float16)
            d["n_words"] = [n_words[i:j].tobytes() for i, j in zip(at, at[1:])]
            d["scores"] = [packed[i:j].tobytes() for i, j in zip(at, at[1:])]
            sums = np.concatenate([np.zeros((1, len(LANGS))), np.cumsum(soft, axis=0, dtype=float)]) if len(x) else np.zeros((1, len(LANGS)))
            own = sums[at[1:]] - sums[at[:-1]]
            for k, v in enumerate(_VECTOR):
                d[v] = own[:, k].astype("float32")
            yield d

    return rows.mapInPandas(run, _SCORED)


_PRIOR = [f"p{k}" for k in range(len(LANGS))]


def _posteriors(stretches: bool, label_lik: np.ndarray):
    """Fuse the evidence; a row a stretch, or a row a language of each text. label_lik: how likely each declared
    language is, in order of LANGS, where the text's is another; in the last row nothing is declared."""
    row_of = {lang: k for k, lang in enumerate(LANGS)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = [len(x) // 4 for x in b["n_words"]]
            n = np.frombuffer(b"".join(b["n_words"]), dtype=np.int32)
            if not len(n):
                continue
            x = np.frombuffer(b"".join(b["scores"]), dtype=np.float16).reshape(-1, len(LANGS)).astype(float)
            row = np.repeat(np.arange(len(b)), counts)
            prior = b[_PRIOR].to_numpy()[row]
            label = label_lik[b["declared"].map(row_of).fillna(len(LANGS)).to_numpy().astype(int)][row]
            # The lowest level of the hierarchy is the text itself: its other stretches.
            soft = _softmax(TEMPER * x) * n[:, None]
            own = np.zeros((len(b), len(LANGS)))
            np.add.at(own, row, soft)
            others = np.maximum(own[row] - soft, 0.0)
            near = (others + TEXT_SMOOTH * prior) / (others.sum(axis=1, keepdims=True) + TEXT_SMOOTH)
            p = _softmax(TEMPER * x + np.log(near) + LABEL_WEIGHT * np.log(label))
            k = p.argmax(axis=1)
            conf = p[np.arange(len(k)), k]
            d = pd.DataFrame({"row": row, "k": k, "words": n, "confidence": conf * n})
            if stretches:
                d["stretch"] = np.arange(len(d)) - np.concatenate([[0], np.cumsum(counts)[:-1]])[row]
            else:
                d = d.groupby(["row", "k"], as_index=False).sum()
                d["stretch"] = 0
            at = d["row"].to_numpy()
            total = np.bincount(row, weights=n, minlength=len(b))
            large = d["words"].to_numpy() >= MIN_SHARE * total[at]
            yield pd.DataFrame({
                "src": b["_src"].to_numpy()[at], "row_id": b["_id"].to_numpy()[at], "declared": b["declared"].to_numpy()[at], "n_distinct": b["n_distinct"].to_numpy()[at],
                "stretch": d["stretch"].astype("int32"), "lang": np.asarray(LANGS, dtype=object)[d["k"].to_numpy()], "words": d["words"].astype("int32"),
                "share": d["words"].to_numpy() / total[at], "n_large": np.bincount(at[large], minlength=len(b))[at].astype("int32"), "confidence": d["confidence"].to_numpy() / d["words"].to_numpy(),
            })

    return run


def _prior(counts: Column, parent: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, parent, lambda n, p: (n + F.lit(SMOOTH) * p) / (total + F.lit(SMOOTH)))


def languages(rows: DataFrame, stretches: bool = False) -> DataFrame:
    """src, row_id, declared, n_distinct, stretch, lang, words, share, n_large, confidence: a row for each language of a
    text (stretch 0), or with ``stretches`` for each stretch between sentence ends, in order. Wordless texts have none.
    n_large: how many languages (stretches) have MIN_SHARE of the text's words and more.

    rows: _src, _id, _label, _host1 (recording), _host2 (source), text; equal rows of one id count once.
    """
    rows = rows.select("_src", "_id", "_host1", "_host2", label_language(F.col("_label")).alias("declared"), "text")
    model = fit(rows)
    # A segment may come again: its evidence is dropped then, so that no text needs to be shuffled.
    again = evidence(rows.where("_src = 'segment'"), model).dropDuplicates(["_src", "_id"])
    ev = written(evidence(rows.where("_src <> 'segment'"), model).unionByName(again), "language-evidence")
    # What texts alone say, counted by host and by label.
    sums = [F.sum(v).cast("double").alias(v) for v in _VECTOR] + [F.count("*").alias("_n")]
    counts = ev.groupBy("_src", "_host1", "_host2", "declared").agg(*sums)
    vector = lambda: F.array(*[F.sum(v) for v in _VECTOR])
    by_label = counts.groupBy("declared").agg(vector().alias("v")).collect()  # at most one row a language
    flat = F.array(*[F.lit(1.0 / len(LANGS))] * len(LANGS))
    zeros = F.array(*[F.lit(0.0)] * len(LANGS))
    whole = counts.groupBy("_src").agg(_prior(vector(), flat).alias("p0"))
    by_source = counts.groupBy(F.col("_src").alias("_s2"), F.col("_host2").alias("_h2")).agg(vector().alias("v2"))
    by_source = by_source.join(F.broadcast(whole), F.col("_s2") == F.col("_src")).select("_s2", "_h2", _prior(F.col("v2"), F.col("p0")).alias("p2"))
    by_rec = counts.groupBy(F.col("_src").alias("_s1"), F.col("_host1").alias("_h1")).agg(vector().alias("v1"))
    hosts = counts.select("_src", "_host1", "_host2").distinct()
    hosts = hosts.join(by_source, (F.col("_src") == F.col("_s2")) & F.col("_host2").eqNullSafe(F.col("_h2")), "left")
    hosts = hosts.join(by_rec, (F.col("_src") == F.col("_s1")) & (F.col("_host1") == F.col("_h1")), "left")
    prior = _prior(F.coalesce("v1", zeros), F.coalesce("p2", flat))
    n_rows = counts.groupBy("_src", "_host1", "_host2").agg(F.sum("_n").alias("_rows"))
    hosts = hosts.select("_src", "_host1", "_host2", prior.alias("prior"))
    hosts = hosts.join(n_rows, [hosts[k].eqNullSafe(n_rows[k]) for k in ("_src", "_host1", "_host2")]).select(hosts["_src"].alias("_s"), hosts["_host1"].alias("_r"), hosts["_host2"].alias("_h"), "prior", "_rows")
    hosts = written(hosts, "host-priors")
    slim = ev.drop(*_VECTOR)
    on = (F.col("_src") == F.col("_s")) & F.col("_host1").eqNullSafe(F.col("_r")) & F.col("_host2").eqNullSafe(F.col("_h"))
    n_hosts, total = hosts.agg(F.count("*"), F.sum("_rows")).first()
    if n_hosts <= MOST_SENT:
        got = slim.join(F.broadcast(hosts), on, "left")
    else:  # a host may have a third of all rows: it is not joined by a shuffle
        hot = F.col("_rows") > HOT_SHARE * total
        known = F.broadcast(hosts.where(hot))
        got = slim.join(known, on).unionByName(slim.join(known, on, "left_anti").join(hosts.where(~hot), on, "left"))
    lik = {r["declared"]: np.asarray(r["v"]) for r in by_label if r["declared"]}
    totals = np.sum([np.asarray(r["v"]) for r in by_label], axis=0) if by_label else np.zeros(len(LANGS))
    label_lik = np.ones((len(LANGS) + 1, len(LANGS)))
    for lang, v in lik.items():
        label_lik[LANGS.index(lang)] = (v + 1.0) / (totals + len(LANGS))
    priors = [F.coalesce(F.col("prior")[k], F.lit(1.0 / len(LANGS))).alias(p) for k, p in enumerate(_PRIOR)]
    got = got.select("_src", "_id", "declared", "n_distinct", "n_words", "scores", *priors)
    return got.mapInPandas(_posteriors(stretches, label_lik), "src string, row_id bigint, declared string, n_distinct int, stretch int, lang string, words int, share double, n_large int, confidence double")


def text_rows(documents: DataFrame, segments: DataFrame, configs: DataFrame) -> DataFrame:
    """Documents and segments as rows of one shape."""
    d = documents.select(F.lit("document").alias("_src"), F.col("doc_id").alias("_id"), F.col("lang").alias("_label"), F.col("recording").alias("_host1"), F.col("source").alias("_host2"), "text")
    s = segments.select("seg_id", "config_id", "recording", "text")
    c = configs.select(F.col("config_id"), F.col("lang").alias("_label")).dropDuplicates(["config_id"])
    s = s.join(c, "config_id", "left").select(F.lit("segment").alias("_src"), F.col("seg_id").alias("_id"), "_label", F.col("recording").alias("_host1"), F.col("config_id").cast("string").alias("_host2"), "text")
    return d.unionByName(s)


def wrong_labels(documents: DataFrame, segments: DataFrame, configs: DataFrame) -> DataFrame:
    """src, row_id, lang, confidence: a row for each language of a tenth and more of the words of a text whose label is
    missing, is not its language, or that holds several languages. Only texts of six different words and more.

    Defined cases: null, empty and wordless texts are no case; a label that names no known language is missing; a null
    recording or source leaves the prior to the next level; equal rows of a re-delivered segment count once; other
    columns are not read; without labelled rows the models know the frequent words alone.
    """
    each = languages(text_rows(documents, segments, configs)).where((F.col("n_distinct") >= MIN_WORDS) & (F.col("share") >= MIN_SHARE))
    case = F.col("declared").isNull() | (F.col("n_large") > 1) | (F.col("lang") != F.col("declared"))
    return each.where(case).select("src", "row_id", "lang", "confidence")
