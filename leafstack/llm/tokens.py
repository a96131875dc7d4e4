"""Token counts by a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary file (ranks of a byte-level BPE); a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenization pattern this vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of ``path``, loaded once per process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("leafstack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens of a text as a long; 0 for an empty text, null for null."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from leafstack.llm.tokens import encoding

        e = encoding(path)
        for batch in batches:
            yield pa.array([None if t is None else len(e.encode_ordinary(t)) for t in batch.to_pylist()], pa.int64())

    return count(text)
