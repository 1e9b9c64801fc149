"""Mapping freely typed names to the entries of a reference list, by a prefix-filter set-similarity join.

A spelling is the set of its letter pairs, once as typed (accents and case folded) and once by its sound. Pairs are
ordered by how rare they are over both sides; only the rarest of each set, its prefix, are joined, for two sets of the
wanted Jaccard similarity must share one there. Length and positional filters follow, then the exact Jaccard, then an
exact check of the edits; the best entry is kept, and what matches none is reported.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread, written
from .script_form import normalized
from .speech import spoken

#: Letter pairs that one edit (a swap of neighbours at most) takes away; folded letters below which only the same
#: spelling counts.
LOST, MIN_FUZZY = 3, 6
#: Matched spellings up to which they are sent to every task; more are joined by a shuffle.
MOST_SENT = 100_000

_ACCENTED = {}
for _cp in (*range(0xC0, 0x250), *range(0x370, 0x400)):
    _d = unicodedata.normalize("NFKD", chr(_cp).lower())
    if len(_b := "".join(c for c in _d if not unicodedata.combining(c))) == 1 and _b != chr(_cp):
        _ACCENTED[chr(_cp)] = _b
# Spellings of one sound, applied in order.
SOUNDS = (
    ("eaux", "o"), ("eau", "o"), ("au", "o"), ("ph", "f"), ("qu", "k"), ("ck", "k"), ("ch", "3"), ("sh", "3"), ("ou", "u"), ("oo", "u"), ("ai", "e"), ("ei", "e"),
    ("y", "i"), ("w", "v"), ("z", "s"), ("c", "k"),
)


def _folded(text: Column, keep: str = "") -> Column:
    x = F.translate(F.lower(text), "".join(_ACCENTED), "".join(_ACCENTED.values()))
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("ł", "l"), ("ø", "o")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(x, rf"(?U)[^\p{{L}}\p{{N}}{keep}]+", "")


def fold(text: Column) -> Column:
    """Letters and digits alone, without case and accents."""
    return _folded(text)


def sound(folded: Column) -> Column:
    """A folded spelling by its sound, doubled letters once."""
    for a, b in SOUNDS:
        folded = F.replace(folded, F.lit(a), F.lit(b))
    return F.regexp_replace(folded, r"(.)\1+", "$1")


def letter_pairs(x: Column) -> Column:
    y = F.concat(F.lit("^"), x, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(y) - 1), lambda i: F.substring(y, i, F.lit(2))))


def one_edit(a: Column, b: Column) -> Column:
    """True for equal strings and those one insertion, deletion, substitution or swap of neighbours apart."""
    d = F.levenshtein(a, b, 2)
    off = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    i = off[0]
    swapped = (F.length(a) == F.length(b)) & (F.size(off) == 2) & (off[1] == i + 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i + 1, F.lit(1))) & (F.substring(a, i + 1, F.lit(1)) == F.substring(b, i, F.lit(1)))
    return F.when((d >= 0) & (d <= 1), F.lit(True)).when(d == 2, swapped).otherwise(F.lit(False))


def reference(glossary: DataFrame) -> DataFrame:
    """term_id, name, words: each term and alias."""
    names = glossary.select("term_id", F.explode(F.array_union(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    return names.where(F.col("name").isNotNull()).select("term_id", fold(F.col("name")).alias("folded"), F.size(F.split(F.trim("name"), r"\s+")).alias("words"), fold(F.element_at(F.split(F.trim("name"), r"\s+"), -1)).alias("tail")).where("folded <> ''").distinct()


def _keys(strings: DataFrame) -> DataFrame:
    """folded, kind ('f' as typed, 's' by sound), key."""
    kinds = F.array(F.struct(F.lit("f").alias("kind"), F.col("folded").alias("key")), F.struct(F.lit("s").alias("kind"), sound(F.col("folded")).alias("key")))
    return strings.select("folded", F.explode(kinds).alias("k")).select("folded", "k.kind", "k.key").where("key <> ''")


def _prefixes(sets: DataFrame, rarity: DataFrame) -> DataFrame:
    """kind, key, n, at, pair: the prefix of each set in the order of rarity. Sets that share all but LOST pairs
    of theirs share one of their LOST + 1 rarest."""
    each = sets.select("kind", "key", F.size("pairs").alias("n"), F.explode("pairs").alias("pair")).join(rarity, ["kind", "pair"], "left")
    ordered = each.groupBy("kind", "key", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "pair"))).alias("o"))
    return ordered.select("kind", "key", "n", F.posexplode(F.slice("o", 1, LOST + 1)).alias("at", "p")).select("kind", "key", "n", "at", F.col("p.pair").alias("pair"))


def similar(queries: DataFrame, ref: DataFrame) -> DataFrame:
    """q, r, jaccard: folded spellings of ``queries`` and of ``ref``, as typed or by sound one edit apart at most.

    The sets of their letter pairs then differ in no more than LOST: a Jaccard similarity of (n - LOST) / (n + LOST)
    for sets of n pairs. Spellings of one sound are one set.
    """
    long = F.length("folded") >= MIN_FUZZY
    qk, rk = _keys(queries.select("folded").where(long).distinct()), written(_keys(ref.select("folded").where(long).distinct()), "names")
    # No key is near a name whose length is not within one of its own: lengths are few, whatever the list.
    lengths = {k: sorted({r["l"] + d for r in rk.where(F.col("kind") == k).select(F.length("key").alias("l")).distinct().collect() for d in (-1, 0, 1)}) for k in "fs"}
    fits = F.lit(False)
    for k, some in lengths.items():
        fits = fits | ((F.col("kind") == k) & F.length("key").isin(*some)) if some else fits
    qk = written(qk.where(fits), "spellings")
    pairs = letter_pairs(F.col("key")).alias("pairs")
    qs, rs = (x.select("kind", "key").distinct().select("kind", "key", pairs) for x in (qk, rk))
    # Rarity over both sides; there are no more pairs than the alphabet squared.
    rarity = qs.unionByName(rs).select("kind", F.explode("pairs").alias("pair")).groupBy("kind", "pair").agg(F.count("*").alias("seen"))
    rarity = written(rarity, "rarity")
    qp = _prefixes(qs, rarity).select("kind", F.col("key").alias("qk"), F.col("n").alias("qn"), F.col("at").alias("qat"), "pair")
    rp = _prefixes(rs, rarity).select("kind", F.col("key").alias("rk"), F.col("n").alias("rn"), F.col("at").alias("rat"), "pair")
    need = F.greatest("qn", "rn") - LOST
    room = 1 + F.least(F.col("qn") - F.col("qat") - 1, F.col("rn") - F.col("rat") - 1)
    length = (F.abs(F.length("qk") - F.length("rk")) <= 1) & (F.abs(F.col("qn") - F.col("rn")) <= LOST)  # one edit changes no more
    near = qp.join(rp, ["kind", "pair"]).where(length & (F.least("qat", "rat") + room >= need)).select("kind", "qk", "rk").distinct()
    near = written(near, "candidates")  # else the dear tests below would be made before these filters
    near = near.where(F.levenshtein("qk", "rk", 2) >= 0)  # a cheap look first: a swap of neighbours counts two
    near = near.withColumns({"a": letter_pairs(F.col("qk")), "b": letter_pairs(F.col("rk"))}).withColumn("both", F.size(F.array_intersect("a", "b")))
    near = near.where((F.col("both") >= F.greatest(F.size("a"), F.size("b")) - LOST) & one_edit(F.col("qk"), F.col("rk")))
    near = near.select("kind", "qk", "rk", (F.col("both") / (F.size("a") + F.size("b") - F.col("both"))).alias("jaccard"))
    near = near.join(qk.select(F.col("folded").alias("q"), "kind", F.col("key").alias("qk")).hint("merge"), ["kind", "qk"]).join(rk.select(F.col("folded").alias("r"), "kind", F.col("key").alias("rk")), ["kind", "rk"])
    return near.groupBy("q", "r").agg(F.max("jaccard").alias("jaccard"))


def closest(queries: DataFrame, ref: DataFrame) -> DataFrame:
    """folded, term_id, words, jaccard: the entry each spelling means; spellings that mean none are absent.

    Short spellings (acronyms) must be equal; others may differ by one edit, as typed or by their sound. A short last
    word of a longer term must be there. The table is written, for it is small and dear.
    """
    named = ref.withColumnRenamed("folded", "r")
    q, r = F.col("q"), F.col("r")
    equal = queries.select(F.col("folded").alias("q")).distinct().join(named, q == r).withColumn("jaccard", F.lit(1.0))
    pairs = similar(queries, ref).where(q != r).join(named, "r")
    tail = (F.col("words") == 1) | (F.length("tail") > 4) | q.endswith(F.col("tail"))
    pairs = pairs.where(tail).unionByName(equal)
    best = F.max_by(F.struct("term_id", "words", "jaccard"), F.struct((q == r).cast("int"), "jaccard", "words", -F.col("term_id"))).alias("b")
    return written(pairs.groupBy(q.alias("folded")).agg(best).select("folded", "b.term_id", "b.words", "b.jaccard"), "meanings")


def texts_in_words(segments: DataFrame) -> DataFrame:
    """seg_id, w: the words of each text in the one form of their letters."""
    rows = spread(segments.select("seg_id", "text").where(F.col("text").isNotNull()), "seg_id").dropDuplicates(["seg_id"])
    rows = normalized(rows).select("seg_id", _folded(spoken(F.col("form")), r"\s\-–—/").alias("t"))
    rows = rows.select("seg_id", F.filter(F.split("t", r"(?U)[\s\-–—/]+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    return written(rows, "words-of-texts")  # read twice: for the spellings, and for the places of those that match


def runs_of_words(rows: DataFrame, longest: int, least: int) -> DataFrame:
    """seg_id, at, n, folded: runs of up to ``longest`` words of each text, of ``least`` letters and more together."""
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)),
        lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("w", i, n), "").alias("folded")))))
    return rows.select("seg_id", F.explode(runs).alias("r")).select("seg_id", "r.at", "r.n", "r.folded").where(F.length("folded") >= least)


def config_entries(configs: DataFrame) -> DataFrame:
    """config_id, entry_pos, folded: the part before '=' of each typed entry."""
    each = configs.select("config_id", F.posexplode("glossary").alias("entry_pos", "e")).dropDuplicates(["config_id", "entry_pos"])
    return each.select("config_id", "entry_pos", fold(F.coalesce(F.element_at(F.split("e", "="), 1), F.lit(""))).alias("folded"))


def _typed(entries: DataFrame, means: DataFrame) -> DataFrame:
    return entries.join(means, "folded", "left").select(
        F.lit("config").alias("src"), F.col("config_id").cast("bigint").alias("row_id"), "entry_pos", F.coalesce("term_id", F.lit(0)).alias("term_id"), "jaccard"
    )


def mapped_entries(configs: DataFrame, glossary: DataFrame) -> DataFrame:
    """src, row_id, entry_pos, term_id, jaccard: the terms that typed entries mean (0: none), as in ``mapped``."""
    entries = config_entries(configs)
    return _typed(entries, closest(entries.where("folded <> ''"), reference(glossary)))


def mapped(segments: DataFrame, configs: DataFrame, glossary: DataFrame) -> DataFrame:
    """src, row_id, entry_pos, term_id, jaccard: the terms that texts name and that typed entries mean (0: none).

    Where a longer term is named at the same place, a shorter one within it is not. As many words of a text are joined
    as the longest name has, and one more, for a name may be split.

    Defined cases: null and empty texts name nothing; a null or empty entry means none (0); null aliases are none;
    equal rows of a re-delivered segment count once; on equal similarity the longer term counts, then the smaller id;
    an empty glossary maps every entry to 0; other columns are not read.
    """
    ref = reference(glossary)
    most = ref.agg(F.max("words").alias("words"), F.min(F.length("folded")).alias("letters")).first()
    rows, entries = texts_in_words(segments), config_entries(configs)
    runs = runs_of_words(rows, (most["words"] or 0) + 1, min(most["letters"] or 0, MIN_FUZZY))
    spellings = runs.select("folded").distinct().unionByName(entries.select("folded").where("folded <> ''")).distinct()
    means = closest(written(spellings, "spelled"), ref)
    # Every run of every text meets the few spellings that match, never the other way round.
    few = F.broadcast(means) if means.count() <= MOST_SENT else means.hint("merge")
    hits = runs.join(few, "folded").groupBy("seg_id").agg(F.collect_list(F.struct("at", "n", "words", "term_id", "jaccard")).alias("h"))
    inside = lambda a, b: (b["words"] > a["words"]) & (b["at"] < a["at"] + a["n"]) & (a["at"] < b["at"] + b["n"])
    named = hits.select("seg_id", F.explode(F.filter("h", lambda a: ~F.exists("h", lambda b: inside(a, b)))).alias("x"))
    named = named.groupBy(F.lit("segment").alias("src"), F.col("seg_id").alias("row_id"), F.lit(-1).alias("entry_pos"), F.col("x.term_id").alias("term_id")).agg(F.max("x.jaccard").alias("jaccard"))
    return named.unionByName(_typed(entries, means))
