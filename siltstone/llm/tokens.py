"""Token counts and token boundaries of texts, by a public byte-level BPE vocabulary.

The vocabulary file and the pre-tokenizing pattern are parameters; by default those of the installed
``public_tokenizers`` package.  A null text has no tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Tokenizer:
    """Encodes texts and knows the length in bytes of each token."""

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("siltstone", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)

    def count(self, text: str | None) -> int:
        return len(self._encoding.encode_ordinary(text)) if text else 0


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str, pattern: str) -> Tokenizer:
    """One tokenizer per Python worker."""
    return Tokenizer(vocabulary, pattern)


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[str | None]:
    """The texts of a batch one by one, so that a batch is never held twice."""
    for value in batch[column]:
        yield value.as_py()


def token_counts(documents: DataFrame, key: str, text: str, keep: list[str] | None = None, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, keep..., n_tokens): the kept columns are passed through unread."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    keep = keep or []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary, pattern)
        for batch in batches:
            n = pa.array([coder.count(t) for t in texts_of(batch, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch[i] for i in range(1 + len(keep))], n], [f"c{i}" for i in range(1 + len(keep))] + ["n_tokens"])

    taken = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate([key, *keep])], F.col(text).alias("text"))
    schema = ", ".join([*[f"c{i} {taken.schema[f'c{i}'].dataType.simpleString()}" for i in range(1 + len(keep))], "n_tokens bigint"])
    return taken.mapInArrow(count, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate([key, *keep])], "n_tokens")
