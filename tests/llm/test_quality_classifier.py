"""The quality classifier: passages and pooling against plain loops, its gradient, held-out labels, odd rows."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from stowage.llm import quality_classifier as qc
from stowage.llm.queries import QUERIES


def plain_passages(text):
    """Features of each passage, a word at a time."""
    raw = (text or "").encode()
    found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    if not found:
        return [[0.0] * qc.FEATURES]
    out = []
    for k in range(0, len(found), qc.PASSAGE):
        mine = found[k : k + qc.PASSAGE]
        end = found[k + qc.PASSAGE][0] if k + qc.PASSAGE < len(found) else len(raw)
        body = raw[mine[0][0] : end]
        counts = [0] * qc.N_GROUPS
        for b in body:
            group = next((g for g, chars in enumerate(qc.GROUPS) if chr(b) in chars and b < 128), None)
            counts[len(qc.GROUPS) + (0 if b < 128 else 1 if b < 192 else 2) if group is None else group] += 1
        words = [raw[a:z] for a, z in mine]
        n = len(words)
        is_letter = lambda b: chr(b).isalpha() and b < 128 or b >= 128
        upper = [sum(65 <= b <= 90 for b in w) for w in words]
        letters = [sum(map(is_letter, w)) for w in words]
        low = [w.lower() for w in words]
        pairs = [(low[i - 1] if i else b"", low[i]) for i in range(n)]
        out.append([math.sqrt(c / len(body)) for c in counts] + [
            n / qc.PASSAGE, math.log1p(sum(map(len, words)) / n), sum(len(w) >= 12 for w in words) / n, sum(len(w) == 1 for w in words) / n, sum(x == 0 for x in letters) / n,
            sum(u == x and x > 1 for u, x in zip(upper, letters)) / n, len(set(low)) / n, sum(low[i] == low[i - 1] for i in range(1, n)) / n, len(set(pairs)) / n,
        ])
    return out


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeABÉ1!#|ü.日") for _ in range(rng.randint(1, 14)))
    many = [rng.choice([" ", "\n", " \t "]).join(word() for _ in range(n)) for n in (1, 63, 64, 65, 128, 700)]
    return [None, "", " \n\t", "  x", "the the the " * 90, *many, "y" * 5000, " ".join("z" * 300 for _ in range(200)), "AB cd " * 3000]


def together(found):
    owners, rows = zip(*found)
    return np.concatenate(owners), np.concatenate(rows)


def test_passages_are_those_of_plain_loops():
    owner, x = together(qc.passages(texts()))
    want = [plain_passages(t) for t in texts()]
    assert np.bincount(owner).tolist() == [len(w) for w in want]
    assert (np.diff(owner) >= 0).all()
    np.testing.assert_allclose(x, np.array([r for w in want for r in w]), atol=1e-12)


@pytest.mark.parametrize("size", [1, 50, 4000])
def test_slices_change_nothing(monkeypatch, size):
    whole = together(qc.passages(texts()))
    monkeypatch.setattr(qc, "SLICE", size)
    cut = together(qc.passages(texts()))
    assert (whole[0] == cut[0]).all()
    np.testing.assert_allclose(whole[1], cut[1])


def test_pooling_in_steps_is_that_of_all_passages():
    rng = np.random.default_rng(1)
    h, logit = rng.normal(size=(50, 3)), rng.normal(size=50) * 20
    pool = qc._Pool()
    for a in range(0, 50, 7):
        pool.add(h[a : a + 7], logit[a : a + 7])
    e = np.exp(logit - logit.max())
    np.testing.assert_allclose(pool.vector / pool.total, e @ h / e.sum())
    assert pool.n == 50 and pool.best == int(logit.argmax())
    np.testing.assert_allclose(1 / pool.total, e.max() / e.sum())


def loss(model, x, bag, y):
    h, logit = model.encode(x)
    total = 0.0
    for k, label in enumerate(y):
        e = np.exp(logit[bag == k] - logit[bag == k].max())
        s = (e @ h[bag == k] / e.sum()) @ model.out[:-1] + model.out[-1]
        total -= math.log(1 / (1 + math.exp(-s if label else s)))
    return total / len(y)


def test_attention_finds_the_passages_that_decide():
    """Bags are good unless one of their passages is odd; no passage is labelled."""
    rng = np.random.default_rng(2)
    bag = np.sort(rng.integers(0, 150, 900))
    bag = np.unique(bag, return_inverse=True)[1]
    x = rng.normal(size=(len(bag), 4))
    odd = rng.random(len(bag)) < 0.08
    x[odd, 2] += 6
    y = np.array([0.0 if odd[bag == k].any() else 1.0 for k in range(bag.max() + 1)])
    before, model = qc.learn(x, bag, y, steps=1), qc.learn(x, bag, y, steps=400)
    assert loss(model, x, bag, y) < 0.1 < loss(before, x, bag, y)
    _, logit = model.encode(x)
    held = [k for k in np.flatnonzero(y == 0) if (bag == k).sum() > 1]
    hits = [odd[bag == k][logit[bag == k].argmax()] for k in held]
    assert np.mean(hits) > 0.9


def test_one_label_gives_its_share():
    model = qc.learn(np.zeros((3, 2)), np.arange(3), np.ones(3))
    h, _ = model.encode(np.zeros((1, 2)))
    assert abs(1 / (1 + math.exp(-(h[0] @ model.out[:-1] + model.out[-1]))) - 3.5 / 4) < 1e-9


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(100, 128)] + [(None, 1, 1), (105, None, 0), (105, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = qc.fit(odd_docs, labels)
    got = qc.score(odd_docs, model).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in odd_rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["top_passage"] < r["n_passages"] and 0 < r["top_weight"] <= 1
    alike = {r["doc_id"]: r["score"] for r in got}
    assert alike[100] == alike[101] == alike[102]  # null, empty and blank
    assert qc.score(no_docs, model).collect() == []
    none = qc.fit(no_docs, labels.limit(0))
    assert {r["score"] for r in qc.score(odd_docs, none).collect()} == {0.5}


def test_bounds_of_the_sample(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 128)], "doc_id long, quality int")
    assert qc.fit(odd_docs, labels, most_passages=10) is not None


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op11_quality_classifier"](spark, d).collect()}
    labels = duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet' where quality is not null").fetchall()
    held = [(got[i]["score"], q) for i, q in labels if got[i]["held_out"]]
    low, high = [s for s, q in held if q == 0], [s for s, q in held if q == 1]
    assert len(low) > 5 and sum(a < b for a in low for b in high) / (len(low) * len(high)) > 0.95
    assert sum(s >= 0.3 for s in high) / len(high) > 0.97 and sum(s < 0.3 for s in low) / len(low) > 0.8
