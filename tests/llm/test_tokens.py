"""Token counts and BPE against the tokenizers library and brute force."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer, models

from docketlake.llm import bpe, token_counts
from docketlake.llm.op1 import vocabulary as pieces
from docketlake.llm.op3 import digests, vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


TEXTS = [None, "", "   \n\t ", "Hello wörld", "<|endoftext|>x y<|startoftext|>", "it's 123 Ångström ﬁ Σας ΣΑΣ İ", "tab\x1cfs\x85nel ls　x", "日本語 テスト 😀😀", "a" * 5000, "!!" * 3000 + " ok", "Ünïcödé_under-score's we'll"]


def test_round_trip_equals_the_library(spark, tokenizer):
    texts = [*TEXTS, "Hello wörld"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in digests(df, vocabulary()).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_tree_of_long_text(tokenizer):
    rng = random.Random(5)
    codec = bpe.Codec(vocabulary(), long=40, leaf=8, window=1)
    for _ in range(200):
        text = "".join(rng.choice(["the", "ing", "a", "b", "é", "ou", "er", "!!", "7", "日"]) for _ in range(rng.randint(1, 400)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode([text.encode()])[0], "<u4").tolist() == want


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([], "text string, ids int, bpe_text int")
    out = bpe.encode_decode(df, vocabulary())
    assert out.columns == ["text", "bpe_text", "ids", "decoded"] and out.count() == 0


def brute(word, trie):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * trie.unknown, best[end - 1][1] - size)]
        options += [(best[a][0] + trie.scores[word[a:end]], best[a][1] - 1) for a in range(end) if word[a:end] in trie.scores]
        best.append(max(options))
    return best[-1][0], -best[-1][1]


def test_counts_equal_brute_force_and_the_library_score():
    scores = token_counts.scores_of(pieces())
    trie = token_counts.PrefixTrie(scores, nodes=200, ends=40, long=30)
    library = Tokenizer(models.Unigram([("<unk>", -1000.0), *((p, s / token_counts.UNIT) for p, s in scores.items())], unk_id=0))
    rng = random.Random(3)
    words = ["".join(rng.choice("theingouerabc日é,.") for _ in range(rng.randint(1, 50))) for _ in range(150)]
    for word in words:
        full = token_counts.SPACE + word
        score, count = brute(full, trie)
        assert trie.count_text(word.encode()) == (1, count)
        tokens = library.encode(full).tokens
        if all(t in scores for t in tokens) and all(c in scores for c in full):
            assert abs(sum(scores[t] for t in tokens) - score) <= 3
    text = " ".join(words)
    assert trie.count_text(text.encode()) == (len(words), sum(brute(token_counts.SPACE + w, trie)[1] for w in words))


def test_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b a", 9), (3, "a b a", 9)], "doc_id long, text string, n_tokens int")
    rows = token_counts.with_counts(df, pieces()).orderBy("doc_id").collect()
    assert [r.n_pretokens for r in rows] == [0, 0, 3, 3] and [r.n_tokens for r in rows][:2] == [0, 0] and rows[2] == rows[3]
    assert token_counts.with_counts(df.limit(0), pieces()).count() == 0
