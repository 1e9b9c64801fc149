"""Sizes of texts in tokens of a public tokenizer. The tokenizer's file is a parameter; every worker reads it."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame

#: A vocabulary file for the ``tokenizers`` library.
TOKENIZER = os.environ.get("PARLANCE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Characters given to the tokenizer at once; a text is never cut.
BATCH_CHARS = 1_000_000


@lru_cache(2)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Sizes(dict):
    """Tokens of " chunk" by chunk, where a chunk stands between single spaces; words repeat, so each is encoded once.

    It holds for tokenizers that split text by the usual byte-level pattern before they merge: a space that stands by
    itself then always begins a new part of the text, and no merge crosses parts. A chunk that is empty or begins with
    white space may be part of a longer run of white space; its size is UNSURE, and such texts are encoded whole.
    """

    UNSURE = -(1 << 50)
    #: Chunks that are kept, and their longest length.
    MOST, LONGEST = 500_000, 64

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    @staticmethod
    def fits(tokenizer) -> bool:
        t = json.loads(tokenizer.to_str())
        p = t.get("pre_tokenizer") or {}
        plain = t.get("normalizer") is None and all(x.get("special") for x in t.get("added_tokens") or [])
        return plain and p.get("type") == "ByteLevel" and p.get("use_regex", True) and not p.get("add_prefix_space", True)

    def __missing__(self, chunk: str) -> int:
        """Of a chunk that is too long to keep."""
        return self.UNSURE if chunk[0].isspace() else len(self.tokenizer.encode(f" {chunk}", add_special_tokens=False).ids)

    def of(self, texts: list[str]) -> list[int]:
        """Tokens of each text, less than nothing where that can't be told by chunks."""
        split = [t.split(" ") for t in texts]
        if len(self) >= self.MOST:
            self.clear()
        new = [c for c in set(chain.from_iterable(split)).difference(self) if len(c) <= self.LONGEST]
        for c, e in zip(new, self.tokenizer.encode_batch_fast([f" {c}" for c in new], add_special_tokens=False)):
            self[c] = self.UNSURE if not c or c[0].isspace() else len(e.ids)
        heads = self.tokenizer.encode_batch_fast([s[0] for s in split], add_special_tokens=False)
        return [len(h.ids) + sum(map(self.__getitem__, islice(s, 1, None))) for h, s in zip(heads, split)]


@lru_cache(2)
def _sizes(path: str) -> Sizes | None:
    return Sizes(t) if Sizes.fits(t := _load(path)) else None


def count(texts: list[str], path: str = TOKENIZER) -> list[int]:
    """Tokens of each text."""
    sizes, tokenizer = _sizes(path), _load(path)
    out = sizes.of(texts) if sizes is not None else [-1] * len(texts)
    whole = [k for k, n in enumerate(out) if n < 0]
    begin = 0
    while begin < len(whole):
        end, chars = begin, 0
        while end < len(whole) and chars <= BATCH_CHARS:
            chars += len(texts[whole[end]])
            end += 1
        for k, e in zip(whole[begin:end], tokenizer.encode_batch_fast([texts[k] for k in whole[begin:end]], add_special_tokens=False)):
            out[k] = len(e.ids)
        begin = end
    return out


def sized(documents: DataFrame, columns: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """``columns`` of the documents and ``tokens``; a null text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[columns].copy()
            out["tokens"] = pd.Series(count([t or "" for t in b["text"]], tokenizer), index=b.index, dtype="int64")
            yield out

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*columns).schema.fields)
    return documents.select(*columns, "text").mapInPandas(run, f"{ddl}, tokens bigint")
