"""Repetition inside single texts: its share, and the texts whose statistics lie outside what is usual.

Each text gives a vector of statistics (share of words in repeated triples, share of repeated sentences, share of the
commonest triple, compression). Vectors are transformed, and per language and source the minimum-covariance-
determinant estimate of centre and spread is fitted: the half to three quarters of the weight whose covariance is
smallest. Texts beyond a quantile of the Mahalanobis distance, on the side of more repetition, are outliers.

The estimate covers all rows: vectors are counted in the cells of a fixed grid by a grouped aggregation, and the
concentration steps run over weighted cells, whose number the grid bounds.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .language import _SEED_OF

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?…\n]+")
DIMS = 4
#: Cells a unit of each transformed statistic; weight of the subset; least spread; quantile of chi-square, 4 degrees.
CELLS, SUBSET, LEAST_SD, CUTOFF = 32, 0.75, 0.08, 9.488
#: Rows of its source's statistics that each stratum takes as a prior: the fewer rows of its own, the more they tell.
PRIOR_ROWS = 200
MIN_WORDS, MIN_SHARE = 8, 0.5
#: A text without repetition, and the rows for which it stands beside those of a source.
IDLE, IDLE_ROWS = (0.0, 0.0, 0.0, 0.5), 50


def words_of(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", text).lower())


def repeated_words(words: list[str]) -> int:
    """Words in a triple of consecutive words that began earlier in the text too."""
    seen: set[tuple[str, str, str]] = set()
    n = upto = 0
    for i, t in enumerate(zip(words, words[1:], words[2:])):
        if t in seen:
            n += i + 3 - max(i, upto)
            upto = i + 3
        else:
            seen.add(t)
    return n


def statistics(text: str | None) -> tuple[int, int, float, float, float, str]:
    """(words, repeated words, share of repeated sentences, share of the commonest triple, compression, language)."""
    w = words_of(text or "")
    if not w:
        return 0, 0, 0.0, 0.0, 1.0, "none"
    s = [x.strip().lower() for x in _SENTENCE.split(text) if x.strip()]
    total = sum(map(len, s)) or 1
    seen: set[str] = set()
    again = 0
    for x in s:
        if x in seen:
            again += len(x)
        seen.add(x)
    counts: dict[tuple, int] = {}
    for t in zip(w, w[1:], w[2:]):
        counts[t] = counts.get(t, 0) + 1
    top = max(counts.values(), default=1)
    raw = text.encode("utf-8", "surrogatepass")
    votes: dict[str, int] = {}
    for x in w:
        if (k := _SEED_OF.get(x)) is not None:
            votes[k] = votes.get(k, 0) + 1
    lang = max(sorted(votes), key=votes.get) if votes else "none"
    return len(w), repeated_words(w), again / total, (top - 1) * 3 / len(w) if top > 1 else 0.0, len(raw) / len(zlib.compress(raw)), lang


_STATS = "src string, row_id bigint, n_words int, n_repeated int, lang string, z array<float>"


def _stat_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for src, i, text in zip(b["src"], b["row_id"], b["text"]):
            n, r, s, t, c, lang = statistics(text)
            # Shares by the arcsine of their root, compression by its logarithm.
            z = [float(np.arcsin(np.sqrt(min(x, 1.0)))) for x in (r / n if n else 0.0, s, min(t, 1.0))] + [float(np.log(max(c, 0.5)))]
            out.append((src, i, n, r, lang, z))
        yield pd.DataFrame(out, columns=["src", "row_id", "n_words", "n_repeated", "lang", "z"])


def mcd(x: np.ndarray, w: np.ndarray, subset: float = SUBSET, steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of the part ``subset`` of the weight with the least determinant, from weighted points."""
    floor = np.eye(x.shape[1]) * LEAST_SD**2
    want = subset * w.sum()

    def moments(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = (x * part[:, None]).sum(0) / part.sum()
        d = x - m
        return m, (d * part[:, None]).T @ d / part.sum() + floor

    def nearest(d: np.ndarray) -> np.ndarray:
        order = np.argsort(d, kind="stable")
        before = np.concatenate([[0.0], np.cumsum(w[order])[:-1]])
        part = np.zeros(len(w))
        part[order] = np.clip(want - before, 0.0, w[order])
        return part

    def median(v: np.ndarray) -> float:
        order = np.argsort(v, kind="stable")
        return v[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)]

    best = None
    mid = np.array([median(x[:, k]) for k in range(x.shape[1])])
    scale = np.array([median(np.abs(x[:, k] - mid[k])) for k in range(x.shape[1])]) + LEAST_SD
    starts = [(((x - mid) / scale) ** 2).sum(1)] + [np.abs(x[:, k] - mid[k]) for k in range(x.shape[1])]
    for d in starts:
        part = nearest(d)
        last = np.inf
        for _ in range(steps):
            m, c = moments(part)
            det = np.linalg.slogdet(c)[1]
            if det >= last - 1e-9:
                break
            last = det
            e = x - m
            part = nearest(np.einsum("ij,jk,ik->i", e, np.linalg.inv(c), e))
        if best is None or last < best[0]:
            best = (last, m, c)
    return best[1], best[2]


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    """Estimates of a source ('*') and of each of its languages, from the cells of all."""
    x = np.vstack(group["cell"].to_numpy()).astype(float) / CELLS
    n = group["n"].to_numpy(float)
    lang = group["lang"].to_numpy()
    whole, weight = np.vstack([x, IDLE]), np.append(n, IDLE_ROWS)  # a handful of rows must not be what is usual
    fits = [("*", *mcd(whole, weight))]
    for k in sorted(set(lang)):
        fits.append((k, *mcd(np.vstack([x[lang == k], whole]), np.append(n[lang == k], weight * (PRIOR_ROWS / weight.sum())))))
    return pd.DataFrame({"src": group["src"].iloc[0], "stratum": [f[0] for f in fits], "centre": [f[1].tolist() for f in fits], "inverse": [np.linalg.inv(f[2]).ravel().tolist() for f in fits]})


def measured(pieces: DataFrame, segments: DataFrame) -> DataFrame:
    """src, row_id, n_words, n_repeated, lang, share, distance, outlier for every text.

    Defined cases: null and wordless texts have no words, share 0 and are no outliers; re-delivered rows count once;
    texts are read whole; an empty table gives no rows; other columns are not read.
    """
    rows = pieces.select(F.lit("piece").alias("src"), F.col("piece_id").alias("row_id"), "text").dropDuplicates(["row_id"])
    rows = rows.unionByName(segments.select(F.lit("segment").alias("src"), F.col("seg_id").alias("row_id"), "text").dropDuplicates(["row_id"]))
    stats = written(rows.mapInPandas(_stat_batches, _STATS), "repetition")
    cells = stats.where("n_words > 0").select("src", "lang", F.transform("z", lambda v: F.round(v * CELLS).cast("int")).alias("cell"))
    cells = cells.groupBy("src", "lang", "cell").agg(F.count("*").alias("n"))
    fits = cells.groupBy("src").applyInPandas(_fit, "src string, stratum string, centre array<double>, inverse array<double>")  # cells are few: the grid bounds them
    fits = F.broadcast(fits)  # a row a language and source: two sources, ten languages
    own = fits.where("stratum <> '*'").select(F.col("src"), F.col("stratum").alias("lang"), F.col("centre").alias("c1"), F.col("inverse").alias("i1"))
    whole = fits.where("stratum = '*'").select("src", F.col("centre").alias("c0"), F.col("inverse").alias("i0"))
    got = stats.join(own, ["src", "lang"], "left").join(whole, "src", "left")

    def distance(c, inv):
        d = F.zip_with("z", c, lambda a, b: a - b)
        terms = [d[i] * d[j] * F.col(inv)[i * DIMS + j] for i in range(DIMS) for j in range(DIMS)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    d1, d0 = distance("c1", "i1"), distance("c0", "i0")
    # Each estimate by its own side: a stratum spoilt by many loops still meets the estimate of its whole source.
    beyond = [F.coalesce((d > CUTOFF) & (F.col("z")[0] > F.col(c)[0]), F.lit(False)) for d, c in ((d1, "c1"), (d0, "c0"))]
    outlier = (beyond[0] | beyond[1]) & (F.col("n_words") > 0)
    share = F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(F.lit(0.0))
    return got.select("src", "row_id", "n_words", "n_repeated", "lang", share.alias("share"), F.greatest(F.coalesce(d1, d0), d0).alias("distance"), outlier.alias("outlier"))


def repeating(pieces: DataFrame, segments: DataFrame) -> DataFrame:
    """src, row_id of texts with at least eight words, half of them and more repeated.

    The exact rule alone decides. The distance is a score beside it, not a gate before it: where much of a stratum
    repeats, texts of half repeated words are usual there and within the cutoff.
    """
    got = measured(pieces, segments)
    return got.where((F.col("n_words") >= MIN_WORDS) & (F.col("n_repeated") >= MIN_SHARE * F.col("n_words"))).select("src", "row_id")
