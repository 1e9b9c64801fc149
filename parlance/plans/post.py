"""Post-processing of finished segments: language filter, glossary, style, numbers, typography; and its counts."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import by_row
from ..functions.glossary import Glossary
from ..functions.text import french_numbers, french_typography, read_style


@dataclass(frozen=True)
class PostConfig:
    """lang_filter needs a column ``confidence`` (language to share). Common words are those of a frequency (Zipf) of
    ``max_zipf`` and more in ``frequencies``."""

    lang: str = "fr"
    lang_filter: bool = True
    glossary: tuple[str, ...] = ()
    style: str = "verbatim"  # or "lu"
    numbers: str = "keep"  # or "digits"
    typography: bool = True
    frequencies: dict[str, float] = field(default_factory=dict, hash=False, compare=False)
    max_zipf: float = 4.0

    def __post_init__(self):
        if self.style not in ("verbatim", "lu") or self.numbers not in ("keep", "digits"):
            raise ValueError("style is 'verbatim' or 'lu', numbers 'keep' or 'digits'")


# Languages that the filter can tell.
FILTER_LANGS = ("fr", "en", "es", "de", "it", "pt", "nl", "pl")


def parse_glossary(entries: str | None, context: str | None = None) -> tuple[str, ...]:
    """Entries parted by commas; those of the context where there are none."""
    return tuple(x for e in (entries or context or "").split(",") if (x := e.strip()))


def top_language(confidence: Column) -> Column:
    """The surest language of a map and how sure it is; of equals the last by name."""
    return F.array_max(F.transform(F.map_entries(confidence), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))


def foreign_language(text: Column, confidence: Column, lang: str, least_words: int = 3, least_other: float = 0.6, most_own: float = 0.05) -> Column:
    """The other language that a text is surely in, else null. Addresses and file names are no evidence; texts of fewer
    than three words are kept, and so is everything where the wanted language is none that can be told."""
    if lang not in FILTER_LANGS:
        return F.lit(None).cast("string")
    said = F.regexp_replace(text, r"(?U)\S*\w[.@]\w\S*", " ")
    words = F.regexp_count(said, F.lit(r"(?U)\w+"))
    top = top_language(confidence)
    own = F.coalesce(F.element_at(confidence, lang), F.lit(0.0))
    return F.when((words >= least_words) & (top["k"] != lang) & (top["v"] >= least_other) & (own <= most_own), top["k"])


_STATS = "text string, glossary array<string>, fillers int, stutters int, numbers int, typography int"


def postprocess(segments: DataFrame, config: PostConfig) -> DataFrame:
    """segments with the new text, dropped_language, glossary (hits, "said -> term"), fillers, stutters, numbers and
    typography (1 where it changed something). Rows in another language have dropped_language and no text; rows left
    without text have a null text. ``kept`` gives the transcript, ``summary`` the counts.

    Order: language filter, glossary, style, numbers, typography, white space. All of a row's text steps are one pass.
    """
    terms = Glossary(list(config.glossary), lambda w: config.frequencies.get(w.strip(".,;:!?…\"'»«()").lower(), 0.0) >= config.max_zipf) if config.glossary else None
    french = config.lang == "fr"

    def one(text):
        hits: Counter = Counter()
        fillers = stuttered = numbers = changed = 0
        if text is None:
            return None, [], 0, 0, 0, 0
        if terms:
            text, hits = terms.apply(text)
        if config.style == "lu":
            text, fillers, stuttered = read_style(text)
        if config.numbers == "digits" and french:
            text, numbers = french_numbers(text)
        if config.typography and french:
            new = french_typography(text)
            changed, text = int(new != text), new
        import re

        text = re.sub(r"\s{2,}", " ", text).strip() or None
        return text, sorted(hits.elements()), fillers, stuttered, numbers, changed

    names = ["text", "glossary", "fillers", "stutters", "numbers", "typography"]
    drop = foreign_language(F.col("text"), F.col("confidence"), config.lang) if config.lang_filter and "confidence" in segments.columns else F.lit(None).cast("string")
    x = segments.withColumn("dropped_language", drop)
    x = x.withColumn("_p", by_row(f"struct<{_STATS.replace(' ', ': ').replace(',:', ',')}>", names)(one)(F.when(F.col("dropped_language").isNull(), F.col("text"))))
    return x.withColumns({n: F.col(f"_p.{n}") for n in names}).drop("_p")


def kept(post: DataFrame) -> DataFrame:
    """The transcript: rows that have text."""
    return post.where(F.col("dropped_language").isNull() & F.col("text").isNotNull())


def summary(post: DataFrame) -> DataFrame:
    """One row of counts: segments_in, dropped_language, empty, glossary, fillers, stutters, numbers, typography."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return post.agg(
        F.count("*").alias("segments_in"),
        F.count_if(F.col("dropped_language").isNotNull()).alias("dropped_language"),
        F.count_if(F.col("dropped_language").isNull() & F.col("text").isNull()).alias("empty"),
        n(F.size("glossary")).alias("glossary"), n("fillers").alias("fillers"), n("stutters").alias("stutters"), n("numbers").alias("numbers"), n("typography").alias("typography"),
    )


def summary_line(counts: dict[str, int]) -> str:
    """One line of what was done."""
    return ", ".join(f"{n} {what}" for what, n in counts.items() if n) or "nothing to do"


def glossary_counts(post: DataFrame) -> DataFrame:
    """said -> term with its count."""
    return post.select(F.explode("glossary").alias("hit")).groupBy("hit").count()


def zipf(words: DataFrame) -> DataFrame:
    """lang, word, zipf: how frequent words are, as log10 of occurrences a thousand million words. words: lang, word."""
    n = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    total = words.groupBy("lang").agg(F.count("*").alias("total"))
    return n.join(total, "lang").select("lang", "word", F.log10(F.lit(1e9) * F.col("n") / F.col("total")).alias("zipf"))
