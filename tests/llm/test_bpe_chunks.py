"""Long texts by chunks: every boundary case against the tokenizer library on the whole text."""

import random

import pytest

from stowage.llm import bpe
from stowage.llm.common import cut

from .test_operators import PATTERN, VOCABULARY, sha


def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh'") for _ in range(rng.randint(1, 12)))
    return [
        "1234567890" * 60,  # groups of digits never meet
        "x" + "123" * 90 + " and " + "1" * 100 + "b" * 200 + " c",
        "a" * 500, " " * 500, "\n \n" * 200, "é" * 200 + " " + "日本" * 150, "it's we'll " * 80, "=" * 300 + " " * 130 + "end",
        " ".join(word() for _ in range(400)), "".join(rng.choice("a1 \n'.-é🙂") for _ in range(1500)),
        *("".join(rng.choice(["7" * rng.randint(1, 70), "z" * rng.randint(1, 90), " ", ".", "\n"]) for _ in range(40)) for _ in range(30)),
    ]


@pytest.mark.parametrize("chunk, overlap", [(64, 32), (33, 9), (48, 48)])
def test_chunks(spark, chunk, overlap):
    rows = list(enumerate(texts())) + [(None, "abc " * 40), (None, None), (3, texts()[3])]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, row int, k int, n int")
    got = bpe.encode_digests(df, VOCABULARY, PATTERN, chunk, overlap).collect()
    encode = bpe.codec(VOCABULARY, PATTERN).encoding.encode_ordinary
    want = [(i, len(encode(t or "")), sha(" ".join(map(str, encode(t or "")))), sha(t or "")) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_long_text_is_many_tasks(spark):
    """One text of 4 MB: its chunks are encoded by more than one task and no run holds more than a few."""
    text = " ".join(f"word{i % 977} of {i}" for i in range(300_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert len(text) > 4_000_000
    numbered = df.selectExpr("doc_id", "text", "0L as row")
    chunks = cut(bpe.chunk_rows(numbered).repartition(8, "row", "k"))
    sizes = bpe.chunk_rows(numbered).repartition(8, "row", "k").selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    assert len(sizes) > 4
    runs = bpe.runs_of(chunks, PATTERN, bpe.CHUNK, bpe.OVERLAP)
    assert runs.where("first < final").isEmpty() and runs.count() == -(-(len(text) - bpe.OVERLAP) // bpe.CHUNK)
    got = bpe.encode_digests(df, VOCABULARY, PATTERN).first()
    ids = bpe.codec(VOCABULARY, PATTERN).encoding.encode_ordinary(text)
    assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))
