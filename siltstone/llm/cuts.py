"""Where a text may be cut: token boundaries and how natural a pause each one is.

Boundaries are positions between tokens; position 0 is the start and n the end.  Strengths: 5 after
an empty line, 4 after a line, 3 after a sentence, 2 after a clause, 1 before a blank, 0 between two
characters, -1 within a character (never cut).
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

from siltstone.llm.tokens import Tokenizer

_NEWLINE, _RETURN = 10, 13


def _bytes(text: str) -> np.ndarray:
    """A table of 256 flags, true for the characters of ``text``."""
    return np.isin(np.arange(256), np.frombuffer(text.encode(), np.uint8))


_BLANK, _SENTENCE, _CLAUSE = _bytes(" \t\n\r"), _bytes(".!?"), _bytes(",;:")
#: Last bytes of marks outside ASCII that end a sentence or a clause, with the two bytes before them.
_WIDE_SENTENCE = np.array([0xE38082, 0xEFBC81, 0xEFBC9F])  # ideographic full stop, wide ! and ?
_WIDE_CLAUSE = np.array([0xE38081, 0xEFBC8C, 0xEFBC9B, 0xEFBC9A])  # ideographic comma, wide , ; :


class Text:
    """A text with its tokens; the byte and strength of each boundary are worked out when asked for."""

    def __init__(self, text: str, coder: Tokenizer):
        self.coder, self.text = coder, text
        self.tokens = coder.encode(text) if text else []
        self.n = len(self.tokens)

    @cached_property
    def data(self) -> bytes:
        return self.text.encode()

    @cached_property
    def at(self) -> np.ndarray:
        """The byte at which each boundary lies."""
        lengths = self.coder.lengths[np.asarray(self.tokens, np.int64)]
        return np.concatenate([[0], np.cumsum(lengths)])

    @cached_property
    def _first_bytes(self) -> np.ndarray:
        return (np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80

    @cached_property
    def _char(self) -> np.ndarray:
        """The number of characters that begin before each boundary."""
        if len(self.data) == len(self.text):
            return self.at
        return np.concatenate([[0], np.cumsum(self._first_bytes)])[self.at]

    @cached_property
    def strength(self) -> np.ndarray:
        return self._strengths(np.frombuffer(self.data, np.uint8)) if self.n else np.zeros(1, np.int8)

    def _strengths(self, raw: np.ndarray) -> np.ndarray:
        padded = np.concatenate([np.zeros(3, np.uint8), raw, np.zeros(1, np.uint8)])
        at = self.at + 3
        before, before2, before3, after = padded[at - 1], padded[at - 2], padded[at - 3], padded[at]
        blank, was_blank = _BLANK[after], _BLANK[before]
        ended = (before == _NEWLINE) | ((before == _RETURN) & (after != _NEWLINE))
        line = ended & (after != _NEWLINE) & (after != _RETURN)
        empty = line & ((before2 == _NEWLINE) | ((before == _RETURN) & (before2 == _RETURN)) | ((before2 == _RETURN) & (before3 == _NEWLINE)))
        sentence = _SENTENCE[before] & blank
        clause = _CLAUSE[before] & blank
        if len(self.data) != len(self.text):
            wide = (before3.astype(np.int64) << 16) | (before2.astype(np.int64) << 8) | before
            sentence |= np.isin(wide, _WIDE_SENTENCE)
            clause |= np.isin(wide, _WIDE_CLAUSE)
        out = np.where(blank & ~was_blank, 1, 0)
        for level, where in ((2, clause), (3, sentence), (4, line), (5, empty)):
            out = np.where(where, level, out)
        inside = np.concatenate([self._first_bytes, [True]])[self.at]
        out = np.where(inside, out, -1)
        out[0] = out[-1] = 5
        return out.astype(np.int8)

    def back(self, i: int) -> int:
        """The last boundary at or before ``i`` that does not cut a character."""
        while self.strength[i] < 0:
            i -= 1
        return i

    def best(self, low: int, high: int, near: float) -> int | None:
        """The strongest boundary in [low, high], of several the nearest to ``near``; None if all cut a character."""
        span = self.strength[low : high + 1]
        top = span.max(initial=-1)
        if top < 0:
            return None
        spots = np.flatnonzero(span == top) + low
        return int(spots[np.argmin(np.abs(spots - near))])

    def piece(self, a: int, b: int) -> str:
        if a == 0 and b == self.n:
            return self.text
        return self.data[self.at[a] : self.at[b]].decode()

    def chars(self, a: int, b: int) -> tuple[int, int]:
        """First character and number of characters of the tokens a..b."""
        if a == 0 and b == self.n:
            return 0, len(self.text)
        return int(self._char[a]), int(self._char[b] - self._char[a])
