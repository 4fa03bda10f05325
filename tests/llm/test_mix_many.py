"""Mixing with very many sources, with clashing columns, and as Pfair windows."""

import math
import time
from collections import Counter

from pyspark.sql import functions as F

from stowage.llm import mixing


def test_many_sources(spark):
    """100,000 small sources beside three large ones."""
    small = spark.range(150_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 100_000).alias("source"))
    large = spark.range(150_000, 300_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("large"), F.col("id") % 3).alias("source"))
    began = time.time()
    rows = mixing.mixed(small.union(large)).collect()
    assert time.time() - began < 60 and len(rows) == 300_000 and len({r.doc_id for r in rows}) == 300_000
    assert len({(r.slot, r.place) for r in rows}) == 300_000
    size = mixing.block_size(300_000)
    assert {r.slot for r in rows} == set(range(len({r.slot for r in rows}))) and max(Counter(r.slot for r in rows).values()) <= size
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r.slot, set()).add(r.source)
    assert all(len(v) == 1 or not any(s.startswith("large") for s in v) for v in by_slot.values())


def brute_windows(shares, sizes):
    """The slot of each block by earliest deadline first, one slot at a time, from release times and deadlines in slots."""
    over = {s: sizes[s] / shares[s] for s in sizes}
    slots = lambda v: sum(shares[s] * min(v, over[s]) for s in sorted(sizes))
    window = {(s, k): (math.floor(slots(k / shares[s]) + 1e-7), math.ceil(slots((k + 1) / shares[s]) - 1e-7)) for s in sizes for k in range(sizes[s])}
    done, out = Counter(), []
    for t in range(sum(sizes.values())):
        heads = [(window[s, done[s]][0] > t, window[s, done[s]][1], s) for s in sizes if done[s] < sizes[s]]
        s = min(heads)[2]
        out.append((s, done[s]))
        done[s] += 1
    return out


def test_schedule_against_brute_force(spark):
    n = {"a": 41, "b": 17, "c": 5, "d": 1}
    df = spark.createDataFrame([(i, s) for s in n for i in range(n[s])], "doc_id long, source string")
    for targets in (None, {"a": 0.1, "b": 0.6, "c": 0.2, "d": 0.1}):
        shares = mixing.source_shares(df, targets=targets)
        plan = sorted(mixing.schedule(shares, 1000, 1).collect(), key=lambda r: r.slot)
        assert [(r.source, r.block) for r in plan] == brute_windows({r.source: r.share for r in shares.collect()}, n)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, "x"), (None, None, 7, 8, None), (1, "a", 5, 6, "x")], "doc_id long, source string, _mix_slot int, slot int, lane string")
    out = mixing.in_mix_order(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert len(mixing.mixed(df).collect()) == 3
