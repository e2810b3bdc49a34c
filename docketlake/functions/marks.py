"""Marking the words of queries in texts, by one automaton over the terms of all queries at hand.

A term is marked where it stands between word bounds, whatever the case; of terms that begin at one place the longest counts, and marks don't overlap. A word
bound lies between an ASCII letter, digit or underscore and anything else, as it does for browsers, and letters are alike if they have one
upper-case form of one character.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

_WORD = np.zeros(128, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[95] = True


def _folded(character: str) -> str:
    upper = character.upper()
    return upper if len(upper) == 1 and ord(character) <= 0xFFFF and not (ord(character) >= 128 > ord(upper)) else character


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        self[code] = _folded(chr(code))
        return self[code]


FOLDS = _Folds()


def _bounds(text: str) -> np.ndarray:
    """Whether there is a word bound before each character, and behind the last."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.zeros(len(codes) + 2, bool)
    word[1:-1] = (codes < 128) & _WORD[np.minimum(codes, 127)]
    return word[1:] != word[:-1]


class Terms:
    """An automaton over terms."""

    def __init__(self, terms: set[str]):
        self.automaton = ahocorasick.Automaton()
        for t in {t.translate(FOLDS) for t in terms}:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()

    def places(self, text: str) -> list[tuple[int, int, str]]:
        """(start, -length, term) of the terms between word bounds, in order."""
        if not len(self.automaton):
            return []
        bounds = _bounds(text)
        found = ((end + 1 - len(t), -len(t), t) for end, t in self.automaton.iter(text.translate(FOLDS)))
        return sorted(f for f in found if bounds[f[0]] and bounds[f[0] - f[1]])


def marked(text: str, places: list[tuple[int, int, str]], terms: list[str]) -> str:
    """The text with the terms marked at those of the places that are theirs; a piece between two marks that is a term itself is marked too."""
    own, plain = {t.translate(FOLDS) for t in terms}, set(terms)
    out, at = [], 0
    for start, length, term in places:
        if term in own and start >= at:
            out += [(text[at:start], False), (text[start : start - length], True)]
            at = start - length
    if not out:
        return text
    out.append((text[at:], False))
    return "".join(f"<mark>{piece}</mark>" if piece.lower() in plain else piece for piece, _ in out)


def highlighted(text: Column, query: Column) -> Column:
    """The text with the query's terms marked; null for a null text, and a text without a query as it is."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, terms in batches:
            terms = [[] if t is None else list(t) for t in terms]
            automaton = Terms({t for own in terms for t in own})
            seen: dict[str, list] = {}
            out = []
            for t, own in zip(texts, terms, strict=True):
                if t is None or not own:
                    out.append(t)
                    continue
                if t not in seen:
                    seen = {t: automaton.places(t)}  # rows of one text mostly stand together
                out.append(marked(t, seen[t], own))
            yield pd.Series(out, dtype=object)

    return run(text, T.query_terms(query))
