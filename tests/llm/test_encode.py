import random

import pytest

from graphloom.llm import encode as X

try:
    from tokenizers import Tokenizer

    REFERENCE = Tokenizer.from_file(f"{X.VOCABULARIES}/byte_bpe_50k.json")
    REFERENCE.encode_special_tokens = True
except Exception:  # noqa: BLE001
    REFERENCE = None

pytestmark = pytest.mark.skipif(REFERENCE is None, reason="the public vocabularies aren't here")


@pytest.fixture(scope="module")
def encoder():
    return X.Encoder(X.vocabulary(f"{X.VOCABULARIES}/byte_bpe_50k.tiktoken"))


def want(text):
    return REFERENCE.encode(text, add_special_tokens=False).ids if text else []


@pytest.mark.parametrize("text", ["", "a", "<|endoftext|> hi", "   \n\n x  y\t", "it's we'll DON'T", "漢字かな交じり文", "🙂🙂👍🏽", "‮abc​", "a" * 600, "ab" * 4000, " " * 900, "é" * 300])
def test_special_texts(encoder, text):
    assert encoder.texts([text])[0].tolist() == want(text)


def test_random_texts(encoder):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab c'sé漢🙂 \n19.the") for _ in range(rng.randint(0, 400))) for _ in range(800)]
    for t, ids in zip(texts, encoder.texts(texts), strict=True):
        assert ids.tolist() == want(t)


def test_table(spark):
    df = spark.createDataFrame([(1, "Hello there", 0), (2, None, 0), (3, "", 0)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in X.ids(df).collect()}
    assert got == {1: want("Hello there"), 2: [], 3: []}
    assert X.ids(df.limit(0)).count() == 0


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "a"), (2, "a")], "doc_id long, text string")
    assert [r["doc_id"] for r in X.ids(df).collect()] == [2]
