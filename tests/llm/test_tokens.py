import base64
import random

import pytest
import tiktoken
from latticework.llm import tokens


@pytest.fixture(scope="module")
def reference():
    with open(tokens.DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.WORDS, mergeable_ranks=ranks, special_tokens={})


def test_equals_rank_order_merging(reference):
    rng, e = random.Random(3), tokens.encoder()
    alphabet = [" ", "  ", "\n", "\t", "a", "b", "ing", " the", " ", "7", "'s", "'ll", ".", "…", "世", "é", "👩‍👧", "<|endoftext|>", "\x1c", "​"]
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))
        assert e.encode(s) == reference.encode_ordinary(s), repr(s)
        assert reference.decode(e.encode(s)) == s


def test_long_words_without_white_space(reference):
    rng, e = random.Random(4), tokens.encoder()
    for s in ["a" * 20_000, "".join(rng.choice("abcXYZ019+/=") for _ in range(25_000)), "ab" * 9_000, "世界" * 4_000]:
        assert e.encode(s) == reference.encode_ordinary(s)


def test_null_empty_blank_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, "a", "x"), (4, "a", "x")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in tokens.encode_corpus(df).orderBy("doc_id").collect()]
    e = tokens.encoder()
    assert got == [(1, []), (2, []), (3, e.encode("  ")), (4, e.encode("a")), (4, e.encode("a"))]
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_full_cache_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    e = tokens.Encoder()
    s = "one two three four five one two six seven eight nine ten"
    assert e.encode(s) == reference.encode_ordinary(s)
