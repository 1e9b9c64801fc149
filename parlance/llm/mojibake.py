"""Text read in the wrong encoding, found and restored by a hidden Markov model over characters.

One state is clean text; each further state is a pair (the encoding the bytes were written in, the one they were read
in, perhaps twice); a last one is loss (replacement characters). A state emits a character by what its inverse
transform makes of it: the probability of that character after its neighbour, in a model of character pairs counted
over all documents that show no valid misread sequence. The best path labels every character; each labelled span gets
its state's inverse transform.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (written in, read in, times) that the model knows.
PAIRS = (
    ("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1250", 1), ("utf-8", "cp1251", 1), ("utf-8", "mac_roman", 1), ("utf-8", "cp437", 1),
    ("utf-8", "cp850", 1), ("utf-8", "cp1253", 1), ("utf-8", "cp1254", 1), ("utf-8", "iso8859-2", 1), ("utf-8", "iso8859-15", 1), ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 2),
    ("cp1252", "cp437", 1), ("cp1252", "cp850", 1), ("cp1252", "mac_roman", 1), ("cp1252", "cp1251", 1), ("cp1252", "cp1250", 1), ("cp1252", "cp1253", 1),
    ("mac_roman", "cp1252", 1), ("cp850", "cp1252", 1), ("cp437", "cp1252", 1),
    ("cp1253", "cp1252", 1), ("iso8859-7", "latin-1", 1), ("cp1250", "cp1252", 1), ("iso8859-2", "latin-1", 1), ("cp1250", "cp1251", 1), ("cp1251", "cp1252", 1),
)
ENTER, LEAVE, FLOOR = -9.0, -1.0, 1e-7
#: Taken from each count of a pair, and added to the count of its first character for each character of all texts: what
#: is seen once, or beside a character that hardly ever comes, tells little.
DISCOUNT, RARE = 0.9, 1e-6
#: Gain below which no stretch of a state wins: entering it, less the leaving of the state before that it saves.
LEAST_GAIN = LEAVE - ENTER - 0.01
#: What is known of a chunk between spaces is kept for so many chunks, of so many characters at most.
MOST_CHUNKS, LONGEST_CHUNK = 500_000, 64
LOST = "�"
#: The states (from 1) of pairs of which both encodings have one byte a character.
ONE_BYTE = tuple(s for s, (written, _, _) in enumerate(PAIRS, 1) if written != "utf-8")


@lru_cache(None)
def _table(codec: str) -> dict[str, int]:
    """Character to byte. Bytes that the codec leaves undefined stand for the control characters of their number."""
    out = {chr(b): b for b in range(128, 256)} if codec not in ("mac_roman", "cp437", "cp850") else {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(None)
def _single(written: str, read: str) -> dict[str, str]:
    """Character to what it was meant to be, for encodings of one byte a character."""
    out = {}
    for ch, b in _table(read).items():
        try:
            x = bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
        if x != ch and ord(x) >= 160:
            out[ch] = x
    return out


def _sequences(codec: str) -> str:
    """A pattern of valid UTF-8 sequences as they look when read in another encoding."""
    t = _table(codec)
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in t.items() if lo <= b <= hi) + "]"
    cont = cls(0x80, 0xBF)
    # Latin, Greek and Cyrillic letters; punctuation and signs; marks of order and loss; pictures.
    return f"{cls(0xC2, 0xD1)}{cont}|{cls(0xE2, 0xE2)}{cont}{{2}}|{cls(0xEF, 0xEF)}{cont}{{2}}|{cls(0xF0, 0xF0)}{cont}{{3}}"


@lru_cache(None)
def _valid(codec: str) -> re.Pattern:
    return re.compile(_sequences(codec))


_CODECS = tuple(dict.fromkeys(r for w, r, _ in PAIRS if w == "utf-8"))


@lru_cache(None)
def _any_valid() -> re.Pattern:
    return re.compile("|".join(_sequences(c) for c in _CODECS))


def _marks(low: int, high: int) -> str:
    return "[" + "".join(sorted({re.escape(c) for k in _CODECS for c, b in _table(k).items() if low <= b <= high})) + "]"


@lru_cache(None)
def _maybe() -> re.Pattern:
    return re.compile(_marks(0xC2, 0xD1) + _marks(0x80, 0xBF) + "|" + _marks(0xE2, 0xF0) + _marks(0x80, 0xBF) + "{2}")


def suspicious(text: str) -> bool:
    """True where a valid misread sequence may be: a quick test first, then the exact one."""
    return bool(_maybe().search(text)) and bool(_any_valid().search(text))


#: A capital letter beyond ASCII right after a small one, or characters that only drawings and controls use.
_ODD = re.compile(r"[a-zß-öø-ÿ][À-ÖØ-ÞΑ-ΩА-Я]|[\x80-\x9f─-▟∀-⋿ⁿ�¬¤¦¨¯´¸¹²³¼½¾]")


def looks_sound(text: str) -> bool:
    return text.isascii() or (not suspicious(text) and not _ODD.search(text))


#: Runs of characters beyond ASCII.
_BEYOND = re.compile(r"[^\x00-\x7f]+")
#: Characters of East Asian scripts, and those beyond the first plane, stand for each other: they never come from one
#: byte, and with one for all of them the model stays as small as the alphabets.
_LARGE = re.compile("[\u2e80-\ud7ff\U00010000-\U0010ffff]")


class _Kept(dict):
    """What a function says of a chunk, kept for chunks that are not too long."""

    def __init__(self, tell):
        super().__init__()
        self.tell = tell

    def __missing__(self, chunk: str):
        x = self.tell(chunk)
        if len(chunk) <= LONGEST_CHUNK:
            self[chunk] = x
        return x


def pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (character, character after it), where one of the two is not ASCII, and of single characters, in texts
    that show no misread sequence. No such sequence has a space in it: texts are told, and counted, by their chunks
    between spaces, each with a space before and after it but for the end of the text."""
    single: Counter = Counter()
    pairs: Counter = Counter()
    chunks: Counter = Counter()
    sound = _Kept(looks_sound)

    def settle() -> None:
        for chunk, n in chunks.items():
            chunk = _LARGE.sub("一", chunk)
            for c in chunk:
                single[c] += n
            for m in _BEYOND.finditer(s := f" {chunk} "):
                run = s[m.start() - 1 : m.end() + 1]
                for pair in zip(run, run[1:]):
                    pairs[pair] += n
        chunks.clear()

    for b in batches:
        for t in b["text"]:
            if t is None:
                continue
            own = t.split(" ")
            if not all(map(sound.__getitem__, own)):
                continue
            chunks.update(own)
            single[" "] += len(own) - 1
            if own[-1] and not own[-1][-1].isascii():
                pairs[_LARGE.sub("一", own[-1][-1]), " "] -= 1
        if len(chunks) > MOST_CHUNKS:
            settle()
        if len(sound) > MOST_CHUNKS:
            sound.clear()
    settle()
    rows = [("", c, k) for c, k in single.items() if k] + [(a, c, k) for (a, c), k in pairs.items() if k]
    yield pd.DataFrame(rows, columns=["a", "c", "n"])


class Characters:
    """P(character | the one before it), from counts."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.pair = {a + c: n for a, c, n in rows if a}
        self.single = {c: n for a, c, n in rows if not a}
        self.total = max(1, sum(self.single.values()))
        self.known: dict[str, float] = {}
        self.most: dict[str, np.ndarray] = {}

    def logp(self, a: str, c: str) -> float:
        if (p := self.known.get(a + c)) is None:
            if len(self.known) > MOST_CHUNKS:
                self.known.clear()
            p = self.known[a + c] = self._logp(_LARGE.sub("一", a), _LARGE.sub("一", c))
        return p

    def gains(self, a: str, c: str) -> np.ndarray:
        """The most that each one-byte state gains over clean text by a character after another, nothing if it loses."""
        if (g := self.most.get(a + c)) is None:
            if len(self.most) > MOST_CHUNKS:
                self.most.clear()
            g = np.zeros(len(ONE_BYTE))
            for k, s in enumerate(ONE_BYTE):
                m = _single(*PAIRS[s - 1][:2])
                if (x := m.get(c)) is not None:
                    g[k] = max(0.0, max(self.logp(b, x) for b in {a, m.get(a, a)}) - self.logp(a, c))
            self.most[a + c] = g
        return g

    def _share(self, a: str, c: str) -> float:
        n, k = self.single.get(a, 0), self.pair.get(a + c, 0)
        return max(0.0, k - DISCOUNT) / (n + RARE * self.total) if n else 0.0

    def _logp(self, a: str, c: str) -> float:
        p = 0.9 * self._share(a, c)
        if c.isupper() and not a.islower():  # text in capitals is as likely as its small letters
            a, c = a.lower(), c.lower()
            p = max(p, 0.1 * self._share(a, c), 0.01 * self.single.get(c, 0) / self.total)
        return math.log(p + 0.1 * self.single.get(c, 0) / self.total + FLOOR)


def _decoded(text: str, codec: str, times: int) -> list[tuple[str, int, int]]:
    """The characters (and from where to where) that valid sequences of the text stand for, ``times`` misread."""
    s, at = text, None  # at: where each character of s begins in the text, and in the end its length
    for left in range(times - 1, -1, -1):
        t, got = _table(codec), []
        for m in _valid(codec).finditer(s):
            try:
                got.append((bytes(t[c] for c in m.group()).decode("utf-8"), *m.span()))
            except UnicodeDecodeError:
                continue
        if not got:
            return []
        if not left:
            break
        new, begins, joined, end = [], [], [], 0
        for x, a, b in got:
            new.append(s[end:a] + x)
            begins += [*range(end, a), a]
            joined += [0] * (a - end) + [1]
            end = b
        new.append(s[end:])
        begins += range(end, len(s) + 1)
        joined += [0] * (len(s) - end)
        s, at, once = "".join(new), begins, joined
    if at is None:
        return got
    return [(x, at[a], at[b]) for x, a, b in got if all(once[a:b])]


def _gains(text: str, places: list[int], clean: list[float], m: dict[str, str], model: Characters) -> list[tuple[float, float, str] | None]:
    """What a one-byte state makes of each place: (its gain over clean text, log probability, its character)."""
    out: list[tuple[float, float, str] | None] = []
    own = False
    for k, i in enumerate(places):
        if (x := m.get(text[i])) is None:
            own = False
            out.append(None)
            continue
        before = " " if not i else m[text[i - 1]] if own and k and places[k - 1] == i - 1 else text[i - 1]
        lp = model.logp(before, x)
        out.append((lp - clean[k], lp, x))
        own = True
    return out


def _places(text: str) -> list[int]:
    """The places of characters beyond ASCII."""
    return [i for m in _BEYOND.finditer(text) for i in range(*m.span())]


def _most_gained(text: str, places: list[int], model: Characters) -> np.ndarray:
    """No less than what any stretch in each one-byte state gains."""
    out = np.zeros(len(ONE_BYTE))
    for (a, c), n in Counter((text[i - 1] if i else " ", text[i]) for i in places).items():
        out += n * model.gains(a, c)
    return out


class Glance(_Kept):
    """Whether a text may hold a stretch that is not clean, from what is known of its chunks between spaces.

    Exact: a stretch in a state wins only if its gains over clean text sum up to LEAST_GAIN, and those of all chunks'
    places that gain are no less. No sequence of UTF-8 bytes, and no pair within a state, goes across a space.
    """

    CLEAN, LOOK = 0, -1

    def __init__(self, model: Characters):
        super().__init__(self._tell)
        self.model = model
        self.sums = [np.zeros(len(ONE_BYTE))]

    def _tell(self, chunk: str) -> int:
        if chunk.isascii():
            return self.CLEAN
        if len(chunk) > LONGEST_CHUNK or LOST in chunk or suspicious(chunk):
            return self.LOOK
        sums = _most_gained(chunk, _places(chunk), self.model)
        if not sums.any():
            return self.CLEAN
        self.sums.append(sums)
        return len(self.sums) - 1

    def __call__(self, text: str) -> bool:
        if len(self) > MOST_CHUNKS:
            self.clear()
            self.sums = [np.zeros(len(ONE_BYTE))]
        chunks = text.split(" ")
        kinds = set(map(self.__getitem__, chunks))
        kinds.discard(self.CLEAN)
        if not kinds or self.LOOK in kinds:
            return bool(kinds)
        counts = Counter(map(self.__getitem__, chunks))
        return bool(sum(counts[k] * self.sums[k] for k in kinds).max() >= LEAST_GAIN)


def label(text: str, model: Characters, gates: bool = True) -> list[tuple[int, int, int, str]]:
    """Spans (from, to, state, restored) that are not clean; state counts from 1 in PAIRS, 0 is loss.

    ``gates`` leaves out states none of whose stretches can gain enough to be entered, which changes nothing."""
    if text.isascii():
        return []
    places = _places(text)
    clean = [model.logp(text[i - 1] if i else " ", text[i]) for i in places]
    # What each state makes of each place: (log probability, first of its sequence, its character); absent: it can't.
    made: list[dict[int, tuple[float, bool, str]]] = [{} for _ in places]
    index = {p: k for k, p in enumerate(places)}
    most = dict(zip(ONE_BYTE, _most_gained(text, places, model)))
    for s, (written, read, times) in enumerate(PAIRS, 1):
        if written == "utf-8":
            if not _valid(read).search(text):
                continue
            before, upto = " ", 0
            for x, a, b in _decoded(text, read, times):
                before = before if a == upto and a else text[a - 1] if a else " "
                lp = model.logp(before, x) if ord(x) >= 160 else math.log(FLOOR)
                for i in range(a, b):
                    made[index[i]][s] = (lp if i == a else 0.0, i == a, x if i == a else "")
                before, upto = x, b
        elif most[s] >= LEAST_GAIN or not gates:
            got = _gains(text, places, clean, _single(written, read), model)
            top = here = 0.0  # the most that consecutive places gain
            for g in got:
                here = max(0.0, here + g[0]) if g else 0.0
                top = max(top, here)
            if top >= LEAST_GAIN or not gates:
                for k, g in enumerate(got):
                    if g:
                        made[k][s] = (g[1], True, g[2])
    for k, i in enumerate(places):
        if text[i] == LOST:
            made[k][0] = (0.0, True, LOST)
    if gates and not any(made):
        return []
    # Viterbi. State -1 is clean.
    best: dict[int, float] = {-1: 0.0}
    back: list[dict[int, int]] = []
    for k in range(len(places)):
        now: dict[int, float] = {}
        came: dict[int, int] = {}
        top = max(best, key=best.get)
        stay, other = best.get(-1, -math.inf), best[top] + LEAVE
        now[-1], came[-1] = (stay, -1) if stay >= other or top == -1 else (other, top)
        now[-1] += clean[k]
        for s, (lp, first, _) in made[k].items():
            v, f = best.get(s, -math.inf), s
            if first and (e := best[top] + ENTER) > v:
                v, f = e, top
            if v > -math.inf:
                now[s], came[s] = v + lp, f
        best = now
        back.append(came)
    s = max(best, key=best.get)
    path = [0] * len(places)
    for k in range(len(places) - 1, -1, -1):
        path[k] = s
        s = back[k][s]
    spans: list[list] = []
    for k, i in enumerate(places):
        s = path[k]
        if s == -1:
            continue
        x = made[k][s][2]
        if spans and k and path[k - 1] == s:
            spans[-1][3] += text[spans[-1][1] : i] + x
            spans[-1][1] = i + 1
        else:
            spans.append([i, i + 1, s, x])
    return [tuple(x) for x in spans]


def restore(text: str, model: Characters) -> tuple[str, list[tuple[int, int, int, str]]]:
    spans = label(text, model)
    out, at = [], 0
    for a, b, _, x in spans:
        out += [text[at:a], x]
        at = b
    return "".join(out) + text[at:], spans


def undress(text: str) -> str:
    """The text with valid misread UTF-8 sequences decoded, without a model: for those who only want its words."""
    for _ in range(2):
        codec = max(_CODECS, key=lambda c: sum(len(m) for m in _valid(c).findall(text)))
        out, end = [], 0
        for x, a, b in _decoded(text, codec, 1):
            out += [text[end:a], x]
            end = b
        if not out:
            break
        text = "".join(out) + text[end:]
    return text


def train(documents: DataFrame) -> Characters:
    """The model of character pairs of all documents. Its size is that of the alphabets: rows by (character, character)
    are summed before they come to the driver."""
    counts = documents.select("text").mapInPandas(pair_counts, "a string, c string, n bigint").groupBy("a", "c").agg(F.sum("n").alias("n"))
    return Characters([(r["a"], r["c"], r["n"]) for r in counts.where("n > 0").collect()])


def restored(documents: DataFrame) -> DataFrame:
    """doc_id, text, restored, spans, found: every document, its labelled spans, and the text with each span put
    through its state's inverse transform.

    Spans name the encodings; loss has nulls and stays as it is. Texts are read whole.

    Defined cases: null, empty and ASCII texts are not found and are their own restored text; repeated rows are
    repeated; other columns are not read.
    """
    names = [(None, None, None), *PAIRS]
    ddl = "doc_id bigint, text string, restored string, spans array<struct<from_ix: int, to_ix: int, written_in: string, read_in: string, times: int>>, found boolean"

    def rows(doc_ids, texts, look, model):
        out = []
        for i, t in zip(doc_ids, texts):
            new, spans = restore(t, model) if t and look(t) else (t, [])
            out.append((i, t, new, [{"from_ix": a, "to_ix": z, "written_in": names[s][0], "read_in": names[s][1], "times": names[s][2]} for a, z, s, _ in spans], bool(spans)))
        return out

    return _labelled(documents, rows, ddl)


def garbled(documents: DataFrame) -> DataFrame:
    """doc_id of the documents that ``restored`` finds. Texts in ASCII don't leave the JVM."""
    some = documents.where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return _labelled(some, lambda ids, texts, look, model: [(i,) for i, t in zip(ids, texts) if look(t) and label(t, model)], "doc_id bigint", documents)


def _labelled(documents: DataFrame, rows, ddl: str, trained_on: DataFrame | None = None) -> DataFrame:
    model = documents.sparkSession.sparkContext.broadcast(train(documents if trained_on is None else trained_on))
    columns = [x.split(" ")[0] for x in re.split(r", (?![^<]*>)", ddl)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = Glance(model.value)
        for b in batches:
            yield pd.DataFrame(rows(b["doc_id"], b["text"], look, model.value), columns=columns)

    return documents.select("doc_id", "text").mapInPandas(run, ddl)
