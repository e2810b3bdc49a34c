"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a mark for the space before it and a run of characters other than ASCII white space. Its tokens are
the pieces of the segmentation with the largest sum of scores; of equal sums the one with fewer tokens.
Pre-tokens are inserted in a trie. A node holds the forward score of its prefix, the best sum over all
segmentations of the prefix, and the tokens that it takes; it depends on the nodes above only, so it is
computed when the node is made and shared by all pre-tokens with that prefix. Ends of pre-tokens store their counts.
Scores are integers, so sums are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import free_name, map_batches, named, slices

SPACE = "▁"
#: Nodes, ends and symbols in their names that a worker's trie holds before it is begun anew, and symbols from which a pre-token is scored aside.
NODES, ENDS, SYMBOLS, LONG = 700_000, 300_000, 24_000_000, 1024
#: Score units for a factor e.
UNIT = 1_000_000


def scores_of(path: str) -> dict[str, int]:
    """Piece -> score for a sentencepiece file: the logarithm of a frequency that falls as 1 / rank, the rank being the piece's place in the file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = math.log(sum(1 / (k + 1) for k in range(len(normal))))
    return {model.id_to_piece(i): round(UNIT * (-math.log(k + 1) - total)) for k, i in enumerate(normal)}


class PrefixTrie:
    """Forward scores of the prefixes of pre-tokens, each computed once."""

    def __init__(self, scores: dict[str, int], nodes: int = NODES, ends: int = ENDS, long: int = LONG, symbols: int = SYMBOLS):
        self.scores, self.limit, self.most_ends, self.long, self.most_symbols = scores, nodes, ends, long, symbols
        # a character that no piece holds becomes its bytes, each less likely than any piece
        self.unknown = min(scores.values(), default=0) - 10 * UNIT
        # lengths of the pieces of three symbols and more, by their last three
        longer: dict[str, set[int]] = {}
        for piece in scores:
            if len(piece) > 2:
                longer.setdefault(piece[-3:], set()).add(len(piece))
        self.longer = {c: sorted(n) for c, n in longer.items()}
        self.ends: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        #: The trie, each node under its prefix: (forward score, tokens). With a prefix all shorter ones are there.
        self.nodes: dict[str, tuple[int, int]] = {"": (0, 0)}
        self.ends.clear()
        self.symbols = 0

    def full(self) -> bool:
        return len(self.ends) >= self.most_ends or len(self.nodes) >= self.limit or self.symbols >= self.most_symbols

    def count(self, word: str) -> int:
        """Tokens of one pre-token; its prefixes stay in the trie, but for one that is very long."""
        nodes, get, longer = self.nodes, self.scores.get, self.longer
        keep = len(word) <= self.long
        low, high = 0, len(word) if keep else 0
        while low < high:  # the longest prefix that is there
            middle = (low + high + 1) // 2
            if word[:middle] in nodes:
                low = middle
            else:
                high = middle - 1
        if keep:
            self.symbols += (len(word) - low) * (len(word) + low) // 2 + len(word)
        path = [nodes[word[:low]]]
        for depth in range(low + 1, len(word) + 1):
            above = path[-1]
            score = get(word[depth - 1])
            if score is None:
                size = len(word[depth - 1].encode("utf-8", "replace"))
                top, few = above[0] + size * self.unknown, above[1] + size
            else:
                top, few = above[0] + score, above[1] + 1
            for n in (2, *longer.get(word[depth - 3 : depth], ())) if depth > 2 else (2,):
                start = depth - n
                if start < 0:
                    break
                score = get(word[start:depth])
                if score is not None:
                    before = path[start - low] if start >= low else nodes[word[:start]]
                    total = before[0] + score
                    if total > top or (total == top and before[1] + 1 < few):
                        top, few = total, before[1] + 1
            node = (top, few)
            path.append(node)
            if keep:
                nodes[word[:depth]] = node
        return path[-1][1]

    def count_text(self, text: bytes) -> tuple[int, int]:
        """(pre-tokens, tokens) of a text."""
        words = text.split()
        ends = self.ends
        for word in set(words):
            if word not in ends:
                if self.full() or len(word) > self.long:
                    return len(words), self._slowly(words)
                ends[word] = self.count(SPACE + word.decode("utf-8", "replace"))
        return len(words), sum(map(ends.__getitem__, words))

    def _slowly(self, words: list[bytes]) -> int:
        """A text's tokens while the trie may be cleared on the way, and very long pre-tokens are not kept."""
        total = 0
        for word in words:
            n = self.ends.get(word)
            if n is None:
                if self.full():
                    self.clear()
                n = self.count(SPACE + word.decode("utf-8", "replace"))
                if len(word) <= self.long:  # a very long one would fill the trie by itself
                    self.ends[word] = n
            total += n
        return total


@lru_cache(maxsize=1)
def shared_trie(path: str) -> PrefixTrie:
    """The trie of a worker process, kept from task to task; bounded by its limits."""
    return PrefixTrie(scores_of(path))


def with_counts(df: DataFrame, path: str, text: str = "text", words: str = "n_pretokens", tokens: str = "n_tokens") -> DataFrame:
    """Append the numbers of pre-tokens and of tokens of each whole text; null and empty texts have none. One pass, no shuffle, rows one to one.

    Columns of df that are named like the new ones are replaced; names may hold dots.
    """
    kept = [c for c in df.columns if c not in (words, tokens)]
    source = df.select(*map(named, kept))
    work = free_name(source, "counted_text")
    schema = T.StructType([*source.schema.fields, T.StructField(words, T.LongType()), T.StructField(tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared_trie(path)
        for batch in slices(batches, work):
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()
            counts = [trie.count_text(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], names=[*kept, words, tokens])

    return map_batches(df.select(*map(named, kept), named(text).cast("string").alias(work)), run, schema)
