"""Splitting oversized items at natural boundaries, by recursive bisection.

A text over the limit is cut at the strongest boundary near its middle; halves that still exceed the
limit minus the overlap are cut again; then each piece but the first takes over the last tokens of the
one before.  Positions are tokens of the whole text.  A cut never falls into a character, for which
the overlap may begin up to three tokens earlier.  Every piece is counted by itself, as a cut can change
how the text around it is split into tokens: it is cut further if its own tokens exceed the limit, and
``n_tokens`` is its own count.

Each text is independent, so no shuffle takes place; the limits are given as plain parameters.

Defined results: a text within the limit is one piece, an empty or null text one empty piece.  Equal
rows give equal pieces.  An overlap below 0 or not below the limit is refused.  A run without blanks is cut between characters; if a single character has
more tokens than the limit, it stays whole.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.cuts import Text
from siltstone.llm.tokens import default_pattern, default_vocabulary, texts_of, tokenizer


def bisect(text: Text, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first token with overlap, first token, end token, own size) of the pieces in order."""
    if text.n <= limit:
        return [(0, 0, text.n, text.n)]
    done: list[tuple[int, int, int, int]] = []
    todo = [(0, text.n)]
    while todo:
        a, b = todo.pop()
        lead = text.back(max(0, a - overlap)) if a else 0
        size = text.coder.count(text.piece(lead, b)) if b - lead <= limit else -1
        if not 0 <= size <= limit and b - a > 1:
            middle, quarter = (a + b) / 2, (b - a) // 4
            low = max(a + 1, a + quarter, overlap if a == 0 and b - a > overlap + 1 else 0)
            cut = text.best(low, max(low, b - 1 - quarter), middle)
            cut = text.best(a + 1, b - 1, middle) if cut is None else cut
            if cut is not None:
                todo += [(cut, b), (a, cut)]
                continue
        done.append((lead, a, b, text.coder.count(text.piece(lead, b)) if size < 0 else size))
    return done


def pieces(documents: DataFrame, key: str, text: str, limits: Sequence[tuple[int, int]], with_text: bool = True, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(max_tokens, key, piece_no, n_pieces, first_token, n_tokens, n_overlap, first_char, n_chars, text) for each (limit, overlap)."""
    if wrong := [(limit, overlap) for limit, overlap in limits if not 0 <= overlap < limit]:
        raise ValueError(f"an overlap must be below its limit: {wrong}")
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    taken = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = taken.schema["key"].dataType.simpleString()
    numbers = ("piece_no", "n_pieces", "first_token", "n_tokens", "n_overlap", "first_char", "n_chars")
    schema = f"max_tokens int, key {kind}, {', '.join(f'{n} int' for n in numbers)}" + ", text string" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary, pattern)
        for batch in batches:
            rows: list[tuple] = []
            held = 0

            def flush() -> pa.RecordBatch:
                columns = [*zip(*rows)] or [()] * (9 + with_text)
                at = pa.array(columns[1], pa.int64())
                arrays = [pa.array(columns[0], pa.int32()), batch["key"].take(at), *[pa.array(c, pa.int32()) for c in columns[2:9]]]
                if with_text:
                    arrays.append(pa.array(columns[9], pa.string()))
                out = pa.RecordBatch.from_arrays(arrays, ["max_tokens", "key", *numbers, *["text"] * with_text])
                rows.clear()
                return out

            for i, value in enumerate(texts_of(batch, "text")):
                whole = Text(value or "", coder)
                for limit, overlap in limits:
                    found = bisect(whole, limit, overlap)
                    for k, (lead, a, b, size) in enumerate(found):
                        row = (limit, i, k, len(found), lead, size, a - lead, *whole.chars(lead, b))
                        rows.append((*row, whole.piece(lead, b)) if with_text else row)
                held += len(whole.text)
                if held > 1 << 23:  # long texts: hand the rows on before they pile up
                    held = 0
                    yield flush()
            yield flush()

    return taken.mapInArrow(cut, schema).withColumnRenamed("key", key)
