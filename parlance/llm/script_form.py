"""One form for texts that look the same: scripts of tokens, look-alike letters, variants, invisible characters.

For each token the script sets of its letters are intersected. An empty intersection is a mixed-script token: it is
spelled in the one script in which every letter stands or has a look-alike. A token of one script all of whose letters
look like letters of the script around it is a whole-script confusable, and is spelled in that script. All other
differences (compatibility variants, composable letters, invisible characters, unusual spaces) are normalized.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import by_row
from ..operators.scans import bucketed, carry, local
from ..session import written

# Letters of other scripts and the Latin letters that look the same (Unicode confusables).
CYRILLIC_LATIN = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "к": "k",
}
GREEK_LATIN = {
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "τ": "t", "γ": "y", "η": "n", "ω": "w", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
}

COMPAT, COMPOSED, INVISIBLE, SPACE, SCRIPT = 1, 2, 4, 8, 16

_SCRIPTS = ("Latin", "Greek", "Cyrillic")
_LOOKS: dict[tuple[str, str], dict[str, str]] = {("Cyrillic", "Latin"): CYRILLIC_LATIN, ("Greek", "Latin"): GREEK_LATIN}
_LOOKS["Latin", "Cyrillic"] = {v: k for k, v in CYRILLIC_LATIN.items()}
#: Letters that are variants of others themselves (a lunate sigma) are never written.
_LOOKS["Latin", "Greek"] = {v: k for k, v in GREEK_LATIN.items() if unicodedata.normalize("NFKC", k) == k}
_LOOKS["Cyrillic", "Greek"] = {c: _LOOKS["Latin", "Greek"][x] for c, x in CYRILLIC_LATIN.items() if x in _LOOKS["Latin", "Greek"]}
_LOOKS["Greek", "Cyrillic"] = {g: _LOOKS["Latin", "Cyrillic"][x] for g, x in GREEK_LATIN.items() if x in _LOOKS["Latin", "Cyrillic"]}

#: A word; an elided one ("l'été") counts as one.
_TOKEN = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_SCRIPT_RE = {s: regex.compile(rf"\p{{Script={s}}}") for s in (*_SCRIPTS, "Han", "Hiragana", "Katakana", "Hangul", "Bopomofo", "Arabic", "Hebrew", "Armenian", "Georgian", "Thai", "Devanagari")}
_ANY = frozenset({"*"})


@lru_cache(65536)
def script_set(ch: str) -> frozenset[str]:
    """The scripts a letter is used in; East Asian scripts that are written together share a set."""
    for s, r in _SCRIPT_RE.items():
        if r.match(ch):
            if s in ("Han", "Hiragana", "Katakana", "Hangul", "Bopomofo"):
                return {"Han": frozenset({"Jpan", "Kore", "Hanb"}), "Hangul": frozenset({"Kore"}), "Bopomofo": frozenset({"Hanb"})}.get(s, frozenset({"Jpan"}))
            return frozenset({s})
    return _ANY


def resolved(token: str) -> frozenset[str]:
    """Intersection of the letters' script sets; empty: the token mixes scripts."""
    out = _ANY
    for ch in token:
        s = script_set(ch)
        if s is not _ANY:
            out = s if out is _ANY else out & s
    return out


@lru_cache(65536)
def _look(ch: str, script: str) -> str | None:
    """``ch`` itself if it is of the script (or of any), else its look-alike there; accents are kept."""
    own = script_set(ch)
    if own is _ANY or script in own:
        return ch
    d = unicodedata.normalize("NFD", ch)
    for s in own:
        if (x := _LOOKS.get((s, script), {}).get(d[0])) is not None:
            return unicodedata.normalize("NFC", x + d[1:])
    return None


def spell(token: str, script: str) -> str | None:
    """The token in one script, or None where a letter has no look-alike."""
    out = [_look(ch, script) for ch in token]
    return None if None in out else "".join(out)


def weak_scripts(token: str) -> frozenset[str]:
    """The other scripts in which the whole token has look-alikes."""
    return frozenset(s for s in _SCRIPTS if s not in resolved(token) and spell(token, s) is not None)


@lru_cache(65536)
def _plain(ch: str) -> tuple[str, int]:
    """The normalized spelling of one character, and what kind of variant it was."""
    cat = unicodedata.category(ch)
    if cat == "Cf" or ch in "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" or 0xFE00 <= ord(ch) <= 0xFE0F:
        return "", INVISIBLE
    if (cat in ("Zs", "Zl", "Zp") and ch != " ") or ch == "\x85":
        return " ", SPACE
    if cat in ("Pd", "Pi", "Pf") or ch in "'\"`‚„′″" or ch == "…":
        return ch, 0
    n = unicodedata.normalize("NFKC", ch)
    return (n, COMPAT) if n != unicodedata.normalize("NFC", ch) else (ch, 0)


def normalize_text(text: str, around: str | None = None) -> tuple[str, int]:
    """(the one form, kinds of variants found). ``around``: the script of the text around it, if known."""
    kinds = 0
    out = []
    for ch in text:
        x, k = _plain(ch)
        kinds |= k
        out.append(x)
    form = "".join(out)
    composed = unicodedata.normalize("NFC", form)
    if unicodedata.normalize("NFC", text) != text:
        kinds |= COMPOSED
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(composed)]
    if composed.isascii() or all(resolved(t) <= frozenset({"Latin", "*"}) and resolved(t) for _, _, t in tokens):
        if around in (None, "Latin"):
            return composed, kinds
    sets = [resolved(t) for _, _, t in tokens]
    strong = [next(iter(s)) if len(s) == 1 and s is not _ANY and not weak_scripts(t) else None for s, (_, _, t) in zip(sets, tokens)]
    before, last = [], around
    for s in strong:
        before.append(last)
        last = s or last
    after, last = [], around
    for s in reversed(strong):
        after.append(last)
        last = s or last
    after.reverse()
    pieces, at = [], 0
    for (a, b, t), s, p, n in zip(tokens, sets, before, after):
        new = None
        if not s:
            counts = {x: sum(script_set(c) == frozenset({x}) for c in t) for x in _SCRIPTS}
            options = [(x in (p, n), counts[x], x) for x in _SCRIPTS if counts[x] and spell(t, x) is not None]
            new = spell(t, max(options, key=lambda o: (o[0], o[2] == "Latin", o[1]))[2]) if options else None
        elif s is not _ANY and (p or n) and not (s & {p, n}):
            new = spell(t, p or n)
        if new is not None and new != t:
            kinds |= SCRIPT
            pieces += [composed[at:a], new]
            at = b
    return unicodedata.normalize("NFC", "".join(pieces) + composed[at:]) if pieces else composed, kinds


def token_scripts(token: str) -> tuple[str | None, str | None]:
    """(script of a token that no look-alikes explain, script of a token that they may explain)."""
    t = unicodedata.normalize("NFC", "".join(_plain(c)[0] for c in token))
    s = resolved("".join(_TOKEN.findall(t)))
    if len(s) != 1 or s is _ANY:
        return None, None
    x = next(iter(s))
    return (None, x) if weak_scripts("".join(_TOKEN.findall(t))) else (x, None)


#: Texts of these characters alone are in the one form already: ASCII, composed Latin letters, typographic marks.
_CLEAN = r"^[\x00-\x7F¡-§©«¬®°±¶·»¿-ıĴ-ľŁ-ňŊ-ž‐-―‘-‟…€]*$"
_GREEK = r"^[\x00-\x40\x5B-\x60\x7B-\x7FΆΈ-ΊΌΎ-ΡΣ-ώ«»‐-―‘-‟…]*$"


def needs_look(text: Column) -> Column:
    """False where the text holds only characters that are no variant of anything."""
    return ~text.rlike(_CLEAN) & ~text.rlike(_GREEK)


_normalize_udf = by_row("struct<form string, kinds int>", ["form", "kinds"])(lambda t: (None, 0) if t is None else normalize_text(t))
_scripts_udf = by_row("struct<strong string, weak string>", ["strong", "weak"])(lambda t: (None, None) if t is None else token_scripts(t))


def _respell(text: str | None, script: str | None) -> str | None:
    if text is None or not script:
        return None
    form = normalize_text(text)[0]
    new = _TOKEN.sub(lambda m: spell(m.group(), script) or m.group(), form)
    return new if new != form else None


_respell_udf = by_row("string")(_respell)


def normalized(df: DataFrame, text: str = "text", form: str = "form", kinds: str = "kinds") -> DataFrame:
    """Add the one form of a text column and the kinds of variants it held (bits of COMPAT, COMPOSED, INVISIBLE,
    SPACE, SCRIPT). Only texts with characters outside the plain ranges go through Python.

    Defined cases: null text gives a null form and no kinds; an empty text is its own form; texts of any length are
    read whole; columns that are named like the results are replaced.
    """
    look = needs_look(F.col(text))
    odd = df.where(look).withColumn("_n", _normalize_udf(F.col(text)))
    rest = df.where(~F.coalesce(look, F.lit(False)))
    keep = [c for c in df.columns if c not in (form, kinds)]
    return (
        odd.select(*keep, F.col("_n.form").alias(form), F.col("_n.kinds").alias(kinds))
        .unionByName(rest.select(*keep, F.col(text).alias(form), F.lit(0).alias(kinds)))
    )


#: Words of a piece in one bucket of the scan over positions.
POS_BUCKET = 4096


def script_hits(words: DataFrame) -> DataFrame:
    """word_id, _new: words that are spelled anew because the words next to them in their piece are of another script.

    Only pieces that hold letters of a further script are scanned, and their words are written once for that.
    """
    foreign = F.col("text").rlike(r"[Ͱ-ԯἀ-῿]")
    few = words.where(foreign & F.col("piece_id").isNotNull()).select("piece_id").distinct()
    near = words.select("word_id", "piece_id", "pos", "text").join(few, "piece_id", "left_semi").dropDuplicates(["word_id"]).withColumn("_s", _scripts_udf("text"))
    near = written(near.select("word_id", "piece_id", "pos", "text", F.col("_s.strong").alias("_strong"), F.col("_s.weak").alias("_weak")), "pieces-of-scripts")

    def neighbour(df: DataFrame, order: str, name: str) -> DataFrame:
        df = bucketed(df, order, POS_BUCKET)
        w = local(["piece_id"], order, "word_id").rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_l", F.last("_strong", ignorenulls=True).over(w))
        df = carry(df, ["piece_id"], {"_c": (F.max_by("_strong", F.when(F.col("_strong").isNotNull(), F.struct(order, "word_id"))), "last")})
        return df.withColumn(name, F.coalesce("_l", "_c")).drop("_l", "_c", "_bucket")

    near = neighbour(near, "pos", "_p")
    near = neighbour(near.withColumn("_neg", -F.col("pos")), "_neg", "_n")
    hits = near.where(
        F.col("_weak").isNotNull()
        & F.coalesce("_p", "_n").isNotNull()
        & ~(F.col("_weak").eqNullSafe(F.col("_p")) | F.col("_weak").eqNullSafe(F.col("_n")))
    )
    return hits.withColumn("_new", _respell_udf("text", F.coalesce("_p", "_n"))).where(F.col("_new").isNotNull()).select("word_id", "_new")


def normalized_words(words: DataFrame) -> DataFrame:
    """word_id, piece_id, pos, text, form, kinds for words that are stored one a row.

    Like ``normalized``, but what surrounds a token are the words next to it in its piece. Re-delivered words give equal
    rows.

    Defined cases: null text gives a null form; a null piece is a piece of its own; ties of pos are ordered by id.
    """
    words = words.select("word_id", "piece_id", "pos", "text")
    out = normalized(words).join(script_hits(words), "word_id", "left")
    return out.select(
        "word_id", "piece_id", "pos", "text",
        F.coalesce("_new", "form").alias("form"),
        F.when(F.col("_new").isNotNull(), F.col("kinds").bitwiseOR(F.lit(SCRIPT))).otherwise(F.col("kinds")).alias("kinds"),
    )


def variants_found(words: DataFrame, segments: DataFrame) -> DataFrame:
    """src ('word' or 'segment'), row_id of texts that are not in the one form: by themselves, or for the words around."""
    words = words.select("word_id", "piece_id", "pos", "text")
    direct = normalized(words.where(needs_look(F.col("text")))).where("kinds > 0").select("word_id")
    w = direct.unionByName(script_hits(words).select("word_id")).distinct().select(F.lit("word").alias("src"), F.col("word_id").alias("row_id"))
    s = normalized(segments.select("seg_id", "text").where(needs_look(F.col("text"))))
    s = s.where("kinds > 0").select(F.lit("segment").alias("src"), F.col("seg_id").alias("row_id")).distinct()
    return w.unionByName(s)
