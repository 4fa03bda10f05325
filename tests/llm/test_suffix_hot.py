"""Grams with many occurrences: digests that collide change nothing, as bytes decide."""

import hashlib
import random

import pytest

from stowage.llm import suffix_dedup


def plain(texts):
    """(n_bytes, n_removed, n_spans, kept digest) by counting every 200-byte string."""
    raws = {i: (t or "").encode() for i, t in texts}
    seen = {}
    for raw in raws.values():
        for a in range(len(raw) - 199):
            seen[raw[a : a + 200]] = seen.get(raw[a : a + 200], 0) + 1
    out = []
    for i, raw in raws.items():
        gone = bytearray(len(raw))
        for a in range(len(raw) - 199):
            if seen[raw[a : a + 200]] > 1:
                gone[a : a + 200] = b"\1" * 200
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


def texts():
    """A passage in many texts with other neighbours each time, some of them alike; runs of one letter; windows that differ in one byte."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, tails = prose(30), [prose(25) for _ in range(3)]
    out = [prose(rng.randint(0, 30)) + passage + rng.choice(tails)[: rng.randint(0, 150)] + prose(rng.randint(0, 20)) for _ in range(25)]
    out += [passage[:100] + chr(65 + i) + passage[101:] + tails[0] for i in range(6)] + ["x" * n for n in (150, 200, 230, 700)] + [None, "", "ab" * 300]
    return list(enumerate(out))


@pytest.mark.parametrize("bits", [64, 7, 1])
def test_forced_collisions(spark, monkeypatch, bits):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "DIGEST_BITS", bits)
    rows = texts()
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_merged_and_dealt_out_alike(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df).collect())) == plain(rows)
    monkeypatch.setattr(suffix_dedup, "HOT", 8)  # some grams of the passage are merged, others aren't
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df).collect())) == plain(rows)
