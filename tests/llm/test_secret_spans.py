"""Secrets in texts with many matches, in short strings, and with samples from very large tables."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from stowage.llm import secrets
from stowage.llm.common import hash_sample, read, running_sums

from .test_operators import brute_secrets


def brute_random(text, ratios):
    """Runs of 12 or more characters of the alphabet that the models take for random and that touch no base span."""
    base = brute_secrets(text)
    for m in re.finditer("[A-Za-z0-9+/_=-]{12,}", text or ""):
        at = [secrets.ALPHABET.index(c) for c in m[0]]
        ratio = sum(ratios[a * len(secrets.ALPHABET) + b] for a, b in zip(at, at[1:]))
        if ratio >= max(secrets.MIN_RATIO, secrets.MIN_RATIO_STEP * (len(at) - 1)) and not any(b[0] < m.end() and m.start() < b[2] for b in base):
            yield m.start(), 3, m.end(), "random"


def check(docs, ratios):
    got = {r.doc_id: r.spans for r in secrets.scan(docs, ratios).collect()}
    for r in docs.select("doc_id", "text").collect():
        spans = sorted([*brute_secrets(r.text), *brute_random(r.text, ratios)])
        assert got[r.doc_id] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans), r.doc_id


def test_spans_against_brute_force(spark, odd_docs):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    ratios = secrets.fit(secrets.labelled_samples(docs))
    check(docs, ratios)
    check(odd_docs, ratios)
    rng = random.Random(5)
    pieces = ["token=abcdef1", "k9X2mQ7vR4tL8pW3", "AKIA" + "Q7" * 9, "deadbeef" * 3, "Zq7Xw2KpVb9T", "ordinary", "user_name_of_it", ": ", " ", "=", "\n", "é", "/"]
    mixed = [(i, "".join(rng.choice(pieces) for _ in range(60))) for i in range(200)]
    check(spark.createDataFrame(mixed, "doc_id long, text string"), ratios)


def test_models_judge_short_strings_and_letters(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    ratios = secrets.fit(secrets.labelled_samples(docs))
    texts = ["x k9X2mQ7vR4tL y", "x qXzKvJwQpGtZbHxW y", "x thereandhere y", "x someofthemorning y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_random for r in secrets.scan(df, ratios).orderBy("doc_id").collect()] == [1, 1, 0, 0]


def test_many_matches_are_linear(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(n))
    text = " ".join(f"token: {word(8)} {word(16)}" for _ in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "a" * 3_000_000)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in secrets.scan(df, [0.0] * 67 * 67).collect()}
    assert got[1].n_assign == 100_000 and got[2].n_assign == 0 and time.time() - began < 60
    some = secrets.scan(df, [2.0] * 67 * 67).where("doc_id = 1").first()
    assert some.n_random == 100_000


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 129, 1000):
        got = spark.range(1).select(F.expr(running_sums(f"transform(slice(sequence(1, {n + 1}), 1, {n}), x -> cast(x as bigint))"))).first()[0]
        assert got == [k * (k + 1) // 2 for k in range(1, n + 1)]


def test_samples_do_not_vanish(spark):
    """A table of any size gives about as many rows as asked for: here a hundredth of a table that says it has 1e13 rows."""
    df = spark.range(200_000).withColumnRenamed("id", "doc_id")
    assert hash_sample(df, "doc_id", 1_000, 200_000, "a").count() in range(850, 1150)
    assert hash_sample(df, "doc_id", 10**11, 10**13, "a").count() in range(1800, 2200)
    assert hash_sample(df, "doc_id", 5, 5, "a").count() == 200_000
    plan = hash_sample(df, "doc_id", 1_000, 10**11, "a")._jdf.queryExecution().optimizedPlan().toString()
    bound = int(re.search(r"<= (-?\d+)", plan)[1]) + (1 << 63)
    assert math.isclose(bound / (1 << 64), 1e-8, rel_tol=1e-6)
