import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrid.llm import tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    with open(tokens.VOCABULARY, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tokens.Encoder(data), tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def agree(pair, texts):
    assert pair[0].encode(texts) == [pair[1].encode_ordinary(t) if t else [] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(pair, texts):
    agree(pair, texts)


def test_words_that_greedy_gets_wrong(pair):
    rng = random.Random(1)
    agree(pair, ["".join(rng.choice("abcdeht s'.0é") for _ in range(80)) for _ in range(3000)])
    assert 0 < pair[0].merged < len(pair[0].known)


def test_long_and_special(pair):
    agree(pair, [None, "", " ", "\t\n", "<|endoftext|>", "ab" * 50_000 + "é" * 9000, "x" * 70_000, " " * 5000 + "a", "日本語" * 3000, "🙂‍🔧\u0085　x"])


def test_tables_are_emptied_when_full(pair, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 4)
    monkeypatch.setattr(tokens, "MOST_PAIRS", 2)
    agree((tokens.Encoder(open(tokens.VOCABULARY, "rb").read()), pair[1]), ["the quick brown fox", "jumps over the lazy dog", "un deux trois"])


def test_exact_merging_alone(pair):
    for word in ("hello", " interdependent", "zzzzzzzzzz", "aaaaaab", "ñandú"):
        assert pair[0].merge(word.encode()) == pair[1].encode_ordinary(word)


def test_frames(spark, pair):
    texts = [None, "", "one two", "one two", "x" * 100_000, "é ü 日本"]
    df = spark.createDataFrame([(i % 4, t, [1], "t") for i, t in enumerate(texts)], "doc_id bigint, text string, ids array<int>, ident string").repartition(2)
    got = sorted((r.doc_id, tuple(r.ids)) for r in tokens.encode(df).collect())
    assert got == sorted((i % 4, tuple(pair[1].encode_ordinary(t) if t else [])) for i, t in enumerate(texts))
    assert tokens.encode(df.limit(0)).count() == 0
    sized = tokens.sizes(df, ["doc_id", "ident"]).collect()
    assert sorted(r.n_tokens for r in sized) == sorted(len(pair[1].encode_ordinary(t)) if t else 0 for t in texts)
