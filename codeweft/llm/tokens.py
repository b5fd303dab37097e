"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Default vocabulary file (byte-level BPE as ranks); any path may be given instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Texts are split here before encoding so that no single run of one kind of character gets slow.
_PIECE = 200_000


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = VOCABULARY) -> int:
    """Tokens of a whole text. Very long texts are encoded in pieces that end at line breaks where there are any."""
    enc = _encoder(path)
    if len(text) <= _PIECE:
        return len(enc.encode_ordinary(text))
    n, at = 0, 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        if end < len(text):
            cut = text.rfind("\n", at + 1, end)
            end = cut if cut > at else end
        n += len(enc.encode_ordinary(text[at:end]))
        at = end
    return n


def sized(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of every document with text; an empty text has 0 tokens, a null one no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "n_tokens": [count(t, path) for t in b["text"]]})

    return docs.where("text is not null").select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, n_tokens bigint")
