"""What a transcript row says: times, speaker labels, sound notes and hesitations taken out of the text.

All of it is JVM regular expressions, so rows never leave whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that label a speaker before a number, in the languages of the transcripts.
LABEL_WORDS = (
    "speaker", "spk", "voice", "s", "locuteur", "locutrice", "intervenant", "intervenante", "orateur", "oratrice", "sprecher", "sprecherin",
    "hablante", "locutor", "locutora", "orador", "oradora", "relatore", "relatrice", "voce", "voz", "voix", "stimme", "parlante", "spreker", "spreekster", "stem",
    "mówca", "mówczyni", "głos", "ομιλητής", "ομιλήτρια", "φωνή", "participant", "participante", "teilnehmer", "deelnemer",
)
# Hesitations; a repeated letter may be longer still.
HESITATIONS = (
    "m+-h?m+", "e+u+h+", "h+e+u+", "h+u+m+", "h+m+", "m{2,}h*", "m+h+m*", "u+h+", "u+h+m+", "u+m+", "e+r+m+", "e+h+m+", "e+h+", "a+h+n+", "h+ã+", "ä+h+m*", "ö+h+m*",
    "e{3,}", "y{3,}", "y+h+m+", "ε{3,}", "ε+μ+", "χ+μ+",
)

_CLOCK = r"\d{1,3}(?::\d{2}){1,2}[.,]\d{1,3}"
TIME = rf"[\[(<]?\s*(?:{_CLOCK})\s*(?:(?:-->|-|–|—)\s*(?:{_CLOCK})\s*)?[\])>]?"
_WORDS = "|".join(sorted(LABEL_WORDS, key=len, reverse=True))
_NAME = rf"(?:{_WORDS})[\s_]*(?:n[°ºo.]|nr\.?|no\.?|#)?[\s_]*"
#: A label in brackets, or a label at the head of a line with its mark. The number is group 1 to 4.
LABEL = (
    rf"(?iU)\[\s*{_NAME}(\d+)\s*\]"
    rf"|\(\s*{_NAME}(\d+)\s*\)"
    rf"|<v\s+{_NAME}(\d+)\s*>"
    rf"|(?<![\p{{L}}\p{{N}}]){_NAME}(\d+)\s*(?:>>|:|-|–|—)(?=\s|$)"
)
NOTE = r"\[[^\]\d]{0,60}\]|\*[^*\d]{1,60}\*|<[^<>\d]{1,60}>"
# Sound notes that stand in round brackets, as names may too.
ROUND_NOTES = (
    "inaudible", "inaudibile", "inaudível", "unverständlich", "onverstaanbaar", "niesłyszalne", "ακατάληπτο", "applaudissements", "applause", "aplausos", "applausi", "applaus",
    "oklaski", "χειροκρότημα", "rires", "laughter", "risas", "risate", "risos", "gelächter", "gelach", "śmiech", "γέλια", "musique", "music", "música", "musica", "musik",
    "muziek", "muzyka", "μουσική", "bruit", "noise", "ruido", "rumore", "ruído", "rauschen", "ruis", "szum", "θόρυβος", "silence", "silencio", "silenzio", "stille", "cisza",
)
_ROUND = rf"(?iU)\(\s*(?:{'|'.join(ROUND_NOTES)})\s*\)"
_DIGIT = r"(?U)\d"
#: Words of the letters of hesitations alone; all others are passed over at a glance.
_HES = "(?iU)(?<![\\p{L}\\p{N}'’])(?=[mheuranãäöyεμχ-]{2,}(?![\\p{L}\\p{N}'’]))(?:" + "|".join(HESITATIONS) + ")(?![\\p{L}\\p{N}'’])(?:\\.{2,}|…|,)?"


def label_number(text: Column) -> Column:
    """The number of the first speaker label in the text, null without one."""
    found = F.regexp_extract(F.regexp_extract(text, LABEL, 0), r"(?U)(\d+)", 1)
    return F.when(text.rlike(_DIGIT), found.try_cast("int"))


def clock_ms(text: Column) -> Column:
    """The first time of day in the text as milliseconds, null without one."""
    found = F.regexp_extract(text, r"(?:\d{1,3}:)?\d{1,3}:\d{2}[.,]\d{1,3}", 0)
    part = lambda g: F.regexp_extract(found, r"(?:(\d{1,3}):)?(\d{1,3}):(\d{2})[.,](\d{1,3})", g)
    number = lambda g: F.coalesce(part(g).try_cast("bigint"), F.lit(0))
    return F.when(text.rlike(_DIGIT) & (found != ""), ((number(1) * 60 + number(2)) * 60 + number(3)) * 1000 + F.rpad(part(4), 3, "0").try_cast("bigint"))


def without_marks(text: Column) -> Column:
    """Text without times, speaker labels and sound notes; hesitations stay."""
    # Each is looked for only where the text has a character that it can't do without.
    out = F.when(text.rlike(_DIGIT), F.regexp_replace(F.regexp_replace(text, TIME, " "), LABEL, " ")).otherwise(text)
    out = F.when(text.rlike(r"[\[*<]"), F.regexp_replace(out, NOTE, " ")).otherwise(out)
    return F.when(text.rlike(r"\("), F.regexp_replace(out, _ROUND, " ")).otherwise(out)


def spoken(text: Column) -> Column:
    """What is said: without times, labels, sound notes and hesitations, white space collapsed.

    Commas and full stops left without a word before them go too. Null stays null."""
    out = F.regexp_replace(without_marks(text), _HES, " ")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    out = F.regexp_replace(out, r"(?:^|(?<=[.,!?…;:]))\s*[.,;…]+(?=\s|$)", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+([,.])(?=\s|$)", "$1"))


def has_words(said: Column) -> Column:
    """True where at least one letter or digit is left."""
    return F.coalesce(said.rlike(r"[\p{L}\p{N}]"), F.lit(False))
