import random

import pytest

from evalmill.llm import tokens


@pytest.fixture(scope="module")
def enc():
    with open(tokens.vocabulary_path(), "rb") as f:
        return tokens.encoding(f.read())


@pytest.mark.parametrize("mask", [0, 3, 511])
def test_chunks_give_the_ids_of_whole_texts(enc, mask, monkeypatch):
    monkeypatch.setattr(tokens, "MASK", mask)
    chunked = tokens.ChunkEncoder(enc, kept_bytes=5000)
    rng = random.Random(mask)
    alphabet = "ab 1.\n\t  é​　中𝕏's\x1c\x85"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(400)]
    texts += ["word " * 3000, "x" * 20_000, " " * 5000, "中文" * 3000, "<|endoftext|> as text"]
    for t in texts:
        assert chunked.encode(t) == enc.encode_ordinary(t)


def test_shared_chunks_are_encoded_once(enc):
    chunked = tokens.ChunkEncoder(enc)
    text = "".join(f"sentence number {i} of a long page. " for i in range(2000))
    chunked.encode(text)
    first = chunked.encoded
    assert chunked.encode("Another start. " + text) == enc.encode_ordinary("Another start. " + text)
    assert chunked.reused > 0.9 * first and chunked.encoded - first < 0.1 * first


def test_query_cases(spark, enc):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Hello world", 0), (3, "Hello world", 0), (4, "é" * 10_000, 0)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in tokens.token_ids(df).collect())
    assert got[:4] == [(1, []), (2, []), (3, enc.encode_ordinary("Hello world")), (3, enc.encode_ordinary("Hello world"))]
    assert got[4][1] == enc.encode_ordinary("é" * 10_000)
    assert tokens.token_ids(df.limit(0)).count() == 0
