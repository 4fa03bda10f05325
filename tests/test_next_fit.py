"""Order-preserving bins against a loop, over ranges that cut bins anywhere."""

import random

import pytest
from pyspark.sql import functions as F

from stowage.operators import packing
from stowage.plans.primitives import next_fit


def loop(sizes, cap):
    used = b = 0
    out = []
    for n in sizes:
        if used + n > cap:
            used, b = 0, b + 1
        used += n
        out.append(b)
    return out


CASES = {
    "many a bin": ([random.Random(1).randint(0, 9) for _ in range(3000)], 4000),
    "one a bin": ([random.Random(2).randint(51, 100) for _ in range(800)], 100),
    "mixed": ([random.Random(3).choice([1, 2, 64, 128, 256]) for _ in range(3000)], 256),
    "equal": ([1] * 2000, 7),
    "one bin of all": ([3] * 500, 10_000),
    "full": ([100] * 300, 100),
    "zeros": ([0] * 200 + [5] + [0] * 200, 5),
    "one row": ([5], 5),
    "none": ([], 5),
}


@pytest.mark.parametrize("name", CASES)
def test_bins(spark, many_tasks, name):
    sizes, cap = CASES[name]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "k long, n long, bin_like string")
    got = {r.k: r.bin for r in next_fit(df, ["k"], F.col("n"), cap).collect()}
    assert [got[i] for i in range(len(sizes))] == loop(sizes, cap)


def test_padded_sizes_share_the_budget(spark):
    free = lambda *xs: spark.createDataFrame(list(enumerate(xs)), "sub_piece_cid long, raw_size long")
    none = spark.createDataFrame([], "idx long")
    got = lambda df, cap: [(r.idx, r.oversized) for r in packing.append_aggregates(df, none, cap).orderBy("sub_piece_cid").collect()]
    assert got(free(70, 70, 70), 256) == [(0, False), (0, False), (1, False)]
    assert got(free(200), 200) == [(None, True)] and got(free(127, 128), 256) == [(0, False), (1, False)]
