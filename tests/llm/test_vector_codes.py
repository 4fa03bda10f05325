"""Vector codes against plain rounds over all distances, and on odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from stowage.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, part int, near string"


def plain(rows, rounds=6):
    rows = [(i, v, lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = 8 * math.ceil(max(len(v) for _, v, _ in rows) / 8) or 8
    x = np.array([[math.floor(4096 * c) for c in v] + [0] * (width - len(v)) for _, v, _ in rows]).reshape(len(rows), 8, -1)
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][2] if rows[k][2] is not None else -1, x[k].ravel().tolist()))[:16]
    books = [x[first, p].copy() for p in range(8)]
    assign = lambda: [(d.argmin(1), d.min(1)) for d in (((x[:, p][:, None] - books[p][None]) ** 2).sum(2) for p in range(8))]
    for _ in range(rounds):
        for p, (near, _) in enumerate(assign()):
            for e in range(len(books[p])):
                if (near == e).any():
                    books[p][e] = x[near == e, p].sum(0) // (near == e).sum()
    last = assign()
    errors, labels = sum(d for _, d in last), {}
    for (_, _, lab), e in zip(rows, errors):
        labels[lab] = labels.get(lab, 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    code = ["".join(f"{near[k]:02x}" for near, _ in last) for k in range(len(rows))]
    return sorted(map(repr, [(i, c, int(e), labels[lab], digest) for (i, _, lab), c, e in zip(rows, code, errors)]))


def check(spark, rows):
    got = vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(rows)


def clustered(rng, n, width=16):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(i, [float(np.float32(c + rng.gauss(0, 0.2))) for c in rng.choice(centres)], rng.choice([None, 0, 1]), 3, "x") for i in range(n)]


def test_as_plain_rounds(spark):
    check(spark, clustered(random.Random(3), 400))


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = clustered(rng, 60)
    rows += [(100, None, 1, None, None), (101, [1.0, None] * 8, 1, None, None), (102, [float("nan")] * 16, None, 1, ""), (103, [float("inf")] * 16, 0, 1, ""), (None, [0.5] * 16, None, 1, "")]
    rows += [rows[5], rows[5], (104, [0.25] * 5, 1, 1, ""), (105, [], None, 1, "")]  # repeats, a short and an empty vector
    check(spark, rows)


def test_ties_and_few_rows(spark):
    check(spark, [(i, [float(i % 2)] * 8, 0, 1, "") for i in range(9)])
    check(spark, [(7, [0.5] * 8, None, 1, "")])


def test_no_rows(spark):
    for rows in ([], [(1, None, 1, 1, "")]):
        out = vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA))
        assert out.collect() == [] and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("b", [0, 1, 4, 9])
def test_bounds_hold_as_entries_move(b):
    """Whatever is kept, assignments are those of all distances, round after round."""
    rng = np.random.default_rng(b)
    x, part = rng.integers(-900, 900, (600, 3)), np.tile(np.arange(2), 300)
    books = rng.integers(-900, 900, (2, 10, 3))
    state = vector_codes.Bounds.unknown(x, part, 10, b)
    skipped = 0
    for k in range(12):
        state.assign(books)
        every = ((books[part] - x[:, None]) ** 2).sum(2)
        assert (state.near[:, 0] == every.argmin(1)).all()
        skipped += int((state.asked == 0).sum()) if k else 0
        if k == 5:
            state.narrow(max(0, b - 1))
        new = books + rng.integers(-60 // (k + 1), 60 // (k + 1) + 1, books.shape)
        moved = np.ceil(np.sqrt(((new - books) ** 2).sum(2))).astype(int)
        books, state.asked = new, np.zeros(len(x), np.int64)
        state.move(moved)
    assert skipped > 0


def test_roots():
    squares = np.array([0, 1, 2, 3, 4, 8, 9, 10**12 - 1, 10**12, (1 << 58) - 1, (1 << 58)])
    assert vector_codes._floor_root(squares).tolist() == [math.isqrt(int(s)) for s in squares]
    assert vector_codes._ceil_root(squares).tolist() == [math.isqrt(int(s) - 1) + 1 if s else 0 for s in squares]
