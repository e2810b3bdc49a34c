"""BPE encoding and decoding of whole texts, with tree concatenation for long unsplit text.

A text falls into chunks at ASCII white space, which neither the normaliser nor the
pre-tokeniser of the tokenizer file carries across; each distinct chunk is encoded once per
worker cache. Where the file's normaliser and pre-tokeniser are the ones that PLAIN knows, chunks of
plain characters are split here and their pre-tokens go to the library's model, each distinct
one once per worker cache; all other chunks go to the library whole. A pre-token that is longer than ``leaf`` symbols
is cut into leaves that are encoded side by side; neighbours are then joined pairwise up a
tree. A join re-encodes a window around the cut and doubles it until its first and last
tokens are those that the two sides have there already. Adjacent tokens of a BPE encoding
are an encoding of their own text, so a sequence whose neighbours all are such pairs is the
encoding of the whole: agreement makes the join exact.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer, models, pre_tokenizers

from ._common import free_name, map_batches, named, slices

#: Symbols of a pre-token from which it is encoded as a tree, symbols of a leaf, tokens in the first window.
LONG, LEAF, WINDOW = 2048, 512, 8
#: Distinct chunks, and as many distinct pre-tokens, that a worker remembers, and bytes of each kind with its ids.
CACHE, CACHE_BYTES = 150_000, 32 << 20
#: Bytes that the interpreter needs for an entry beside its text and ids.
ENTRY = 160
#: The pipeline that the short cut covers, as the tokenizer file states it.
PLAIN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}
#: Printable ASCII and the Latin-1 letters: composed, lowered one by one alike everywhere, and classed alike by both pattern libraries.
PLAIN_CHUNK = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PLAIN_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class TreeBpe:
    """Encodes one pre-token as a balanced tree of leaves."""

    def __init__(self, tokenizer: Tokenizer, leaf: int = LEAF, window: int = WINDOW):
        model = json.loads(tokenizer.to_str())["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        self.leaf, self.window = leaf, window
        self.inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
        self.last = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix)) if suffix else self.inner
        pieces = {i: t for t, i in model["vocab"].items()}
        self.width = [len(pieces[i].removesuffix(suffix) if suffix else pieces[i]) if i in pieces else 0 for i in range(max(pieces) + 1)]

    def encode(self, text: str) -> list[int]:
        cuts = list(range(0, len(text), self.leaf)) or [0]
        if len(cuts) > 1 and len(text) - cuts[-1] < self.leaf // 2:
            cuts.pop()
        spans = list(zip(cuts, [*cuts[1:], len(text)], strict=True))
        parts = [e.ids for e in self.inner.encode_batch([text[a:b] for a, b in spans[:-1]], add_special_tokens=False)]
        parts.append(self.last.encode(text[slice(*spans[-1])], add_special_tokens=False).ids)
        level = list(zip(parts, spans, strict=True))
        while len(level) > 1:
            level = [self._join(text, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0][0]

    def _join(self, text: str, left: tuple, right: tuple) -> tuple:
        (a, (start, cut)), (b, (_, end)) = left, right
        size = self.window
        while True:
            head, tail = a[max(0, len(a) - size) :], b[:size]
            begin, stop = cut - sum(self.width[i] for i in head), cut + sum(self.width[i] for i in tail)
            model = self.last if stop == len(text) else self.inner
            middle = model.encode(text[begin:stop], add_special_tokens=False).ids
            whole_left, whole_right = len(head) == len(a), len(tail) == len(b)
            if (whole_left or middle[:1] == head[:1]) and (whole_right or middle[-1:] == tail[-1:]):
                return a[: len(a) - len(head)] + middle + b[len(tail) :], (start, end)
            size *= 2


def _symbols(character: str) -> str:
    """The symbols that the last pre-tokeniser writes for a character's bytes."""
    return "".join(w for w, _ in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(character))


class Codec:
    """Encodes and decodes whole texts as the tokenizer file does; ids are packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF, window: int = WINDOW, cache: int = CACHE, cache_bytes: int = CACHE_BYTES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.long, self.leaf, self.window, self.limit, self.most_bytes = long, leaf, window, cache, cache_bytes
        self.held = self.word_bytes = 0  # bytes of the chunks and of the pre-tokens that are remembered
        self.cache: dict[bytes, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self._tree: TreeBpe | None = None
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = np.array([self.tokenizer.id_to_token(i) for i in range(size)], dtype=object)
        spec = json.loads(self.tokenizer.to_str())
        self.plain = spec["decoder"] is None
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.known = (
            spec.get("normalizer") == PLAIN["normalizer"]
            and [p["type"] for p in steps] == ["Split", "ByteLevel"]
            and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": PLAIN["split"]}, "Removed", True)
            and (steps[1]["add_prefix_space"], steps[1]["use_regex"]) == (False, False)
        )
        self.words: dict[str, bytes] = {}
        self.symbols = {}
        if self.known:
            for c in sorted({*map(chr, range(33, 127)), *map(chr, range(0xC0, 0x100))} - {"\u00d7", "\u00f7"}):
                self.symbols[ord(c)] = _symbols(c)

    @property
    def tree(self) -> TreeBpe:
        if self._tree is None:
            self._tree = TreeBpe(self.tokenizer, self.leaf, self.window)
        return self._tree

    def _long_chunk(self, chunk: str) -> list[int]:
        """Ids of a long chunk; those of its pre-tokens that are long go through the tree."""
        if any(t in chunk for t in self.added):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        text = self.tokenizer.normalizer.normalize_str(chunk) if self.tokenizer.normalizer else chunk
        words = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        out: list[int] = []
        for word in words:
            out += self.tree.encode(word) if len(word) > self.long else [t.id for t in self.model.tokenize(word)]
        return out

    def learn(self, chunks: set[bytes]) -> None:
        """Encode the chunks that are not remembered yet; beyond the bounds, only those of this call stay."""
        new = [c for c in chunks if c not in self.cache]
        if len(self.cache) + len(new) > self.limit or self.held > self.most_bytes:
            self.cache = {c: self.cache[c] for c in chunks if c in self.cache}
            self.held = sum(ENTRY + len(c) + len(ids) for c, ids in self.cache.items())
        short = []
        for c in new:
            if len(c) <= self.long:
                text = c.decode(errors="replace")
                if self.known and PLAIN_CHUNK.fullmatch(text) and not any(t in text for t in self.added):
                    self.cache[c] = self._plain(text)
                else:
                    short.append(c)
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            for c, e in zip(part, self._batch([c.decode(errors="replace") for c in part], add_special_tokens=False), strict=True):
                self.cache[c] = np.array(e.ids, dtype="<u4").tobytes()
        for c in new:
            if len(c) > self.long:
                self.cache[c] = np.array(self._long_chunk(c.decode(errors="replace")), dtype="<u4").tobytes()
        self.held += sum(ENTRY + len(c) + len(self.cache[c]) for c in new)

    def _plain(self, text: str) -> bytes:
        words = PLAIN_TOKEN.findall(text.lower())
        out = []
        for word in words:
            ids = self.words.get(word)
            if ids is None:
                if len(self.words) >= self.limit or self.word_bytes > self.most_bytes:
                    self.words.clear()
                    self.word_bytes = 0
                ids = self.words[word] = np.array([t.id for t in self.model.tokenize(word.translate(self.symbols))], dtype="<u4").tobytes()
                self.word_bytes += ENTRY + len(word) + len(ids)
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, dtype="<u4")
        if self.plain:
            return " ".join(self.pieces[ids].tolist())
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(maxsize=1)
def shared_codec(path: str, long: int, leaf: int, window: int) -> Codec:
    """The codec of a worker process, kept from task to task with what it remembers."""
    return Codec(path, long, leaf, window)


def encode_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", long: int = LONG, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """Append ``ids`` (binary: little-endian unsigned 32-bit ids of the whole text) and ``decoded`` (their decoding).

    A null or empty text gives no ids and an empty decoding. Rows, repeated ones too, are kept
    one to one; no shuffle. Columns of the input with the names of the new ones are replaced; names may hold dots.
    """
    kept = [c for c in df.columns if c not in (ids, decoded)]
    source = df.select(*map(named, kept))
    work = free_name(source, "bpe_text")
    schema = T.StructType([*source.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(path, long, leaf, window)
        for batch in slices(batches, work):
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()
            packed = codec.encode([t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary()), pa.array([codec.decode(p) for p in packed], pa.string())], names=[*kept, ids, decoded])

    return map_batches(df.select(*map(named, kept), named(text).cast("string").alias(work)), run, schema)
