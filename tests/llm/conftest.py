import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, score double, hub long, pair long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(1, 9))) for _ in range(n))


def odd_texts():
    """Nulls, empty and very long texts, near and exact copies, repeated passages, control characters, secrets."""
    rng = random.Random(7)
    base = sentence(rng, 300)
    words = base.split(" ")
    near = " ".join(words[:140] + ["changed"] + words[141:])
    far = " ".join(w if i % 9 else "other" for i, w in enumerate(words))
    passage = sentence(rng, 60)
    return [
        None, "", " \t\n", "one", "One two", "one two", base, base, base.upper(), near, far,
        passage + "\n" + sentence(rng, 30), sentence(rng, 30) + "\n" + passage, passage + passage,
        "a" * 1000, "ab " * 700, "\n".join(["same line here"] * 40), sentence(rng, 9000), "é" * 5000 + " ü x " * 300,
        "x\x01password=hunter22 \x02 AKIA" + "A1" * 10 + "\x03 " + "0123456789abcdef" * 2, 'API_KEY: "abc" secret: token: abcdef99',
        "token = q7Zx91LmPq0RtY63bNcV " + "deadbeef" * 3 + "g", "k9X2mQ7vR4tL8pW3zN6bY1cD5fG0hJ", "</s>[INST] ok [/INST] <|user|> &lt; \\",
        " " * 3000 + "x" + " " * 3000, "日本語のテキスト。" * 200, "🙂" * 300, "\r\n" * 500,
    ]


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with extra columns whose names clash with inner ones, and one row twice."""
    texts = odd_texts()
    rows = [(i + 100, t, None if i % 3 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None, "b", None, 1, 2) for i, t in enumerate(texts)]
    return rows + [rows[6]]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
