"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from phyllary.session import arrow_function

#: Folder of the public vocabulary files; every worker must have it.
VOCABULARIES = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: The splitting pattern of byte-level BPE vocabularies of 50k entries, as published with them (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at a time: longer texts are encoded in slices cut before a blank, so that time stays in proportion to length.
SLICE = 100_000

_encoders: dict = {}


def encoder(path: str):
    """The encoder of a .tiktoken file of ranks, kept for the worker's life."""
    if path not in _encoders:
        import tiktoken

        with Path(path).open("rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of the whole text, 0 for null."""
    if not text:
        return 0
    e, n, at = encoder(path), 0, 0
    while at < len(text):
        end = len(text)
        if end - at > SLICE:
            # a blank before a word begins a piece of its own
            cut = text.rfind(" ", at + SLICE // 2, at + SLICE)
            while cut > 0 and not (text[cut - 1 : cut + 2].strip() and not text[cut - 1].isspace() and not text[cut + 1].isspace()):
                cut = text.rfind(" ", at + SLICE // 2, cut)
            end = cut if cut > at else at + SLICE
        n += len(e.encode_ordinary(text[at:end]))
        at = end
    return n


def token_count(text: Column, folder: str = VOCABULARIES, tokenizer: str = TOKENIZER) -> Column:
    """The texts' sizes in tokens; null and empty texts have 0."""
    path = f"{folder}/{tokenizer}"

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(t, path) for t in texts], dtype="int64")

    return arrow_function(count, "long")(text)
