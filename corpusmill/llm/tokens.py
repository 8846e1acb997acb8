"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.runtime import spread

#: Fixed value: how the byte-level BPE vocabularies cut a text before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_PIECES = 1 << 18


def tokenizer_dir() -> str:
    """The folder of the public tokenizers' files: CORPUSMILL_TOKENIZERS, else the installed package's folder."""
    if named := os.environ.get("CORPUSMILL_TOKENIZERS"):
        return named
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


class PieceCounter:
    """Tokens of a text under a byte-level BPE: the sum over its pieces, and a piece's number is kept, as pieces repeat."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        known = self.known
        total = 0
        for p in self.pieces.findall(text):
            n = known.get(p)
            if n is None:
                n = len(self.encode(p))
                if len(known) < KEPT_PIECES:
                    known[p] = n
            total += n
        return total


def token_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """The columns of `keep` and the number of tokens of `text`; null and empty texts have 0 tokens. Whole texts are counted."""
    path = path or f"{tokenizer_dir()}/byte_bpe_50k.tiktoken"
    keep = keep or [c for c in df.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PieceCounter(path)
        for pdf in batches:
            yield pdf[keep].assign(**{out: [counter.count(t) if t else 0 for t in pdf[text]]})

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType())])
    return spread(df.select(*keep, text)).mapInPandas(run, schema)
