"""Streams cut into slices anywhere give what their batch twins give."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stowage.operators.lifecycle import ALLOWED
from stowage.streaming import jobs


def test_transitions_that_are_not_allowed(spark):
    rng = random.Random(1)
    rows = [(i % 5, i, rng.choice(list(ALLOWED))) for i in range(200)]
    out = jobs.drain(jobs.lifecycle_fold(jobs.as_stream(spark.createDataFrame(rows, "key long, seq long, kind string"), "seq", 3)), "update").collect()
    want = {}
    state = {}
    for key, seq, kind in rows:
        before = state.get(key)
        if before is not None and before not in ALLOWED[kind]:
            want[key, seq] = (before, kind)
        state[key] = "committed" if before == "committed" else kind
    assert {(r.key, r.seq): (r.before, r.kind) for r in out if r.status is None} == want
    last = {}
    for r in sorted((r for r in out if r.status is not None), key=lambda r: r["_batch"]):
        last[r.key] = (r.status, r.n_illegal)
    assert last == {k: (s, sum(1 for x in want if x[0] == k)) for k, s in state.items()}


def test_alarms_whatever_the_slices(spark):
    rng = random.Random(2)
    zero = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(4), zero + dt.timedelta(minutes=rng.randrange(5000)), rng.choice(["parked", "committed", "failed"]), i) for i in range(150)]
    want = set()
    for b in range(4):
        rose = sorted({t for k, t, kind, _ in rows if k == b and kind != "parked"})
        for t in {*rose, min(t for k, t, _, _ in rows if k == b)}:
            if not any(t < u <= t + dt.timedelta(minutes=60) for u in rose):
                want.add((b, t))
    end = [(-1, zero + dt.timedelta(days=60), "parked", 10_000)]
    df = spark.createDataFrame(rows + end, "batch long, ts timestamp, kind string, seq long")
    for slices in (2, 5):
        out = jobs.drain(jobs.stall_watchdog(jobs.as_stream(df, "seq", slices), 3600, "20 days")).collect()
        assert {(r.batch, r.since) for r in out if r.batch >= 0} == want and len([r for r in out if r.batch >= 0]) == len(want)


def test_a_repeated_trigger_plans_the_same(spark, tmp_path):
    """The second trigger is planned twice, as after a crash; the record of the third isn't there yet."""
    sub = spark.createDataFrame([(i, 100) for i in range(12)], "sub_piece_cid long, raw_size long")
    seen = {}
    real = jobs.drain

    def drain(stream, mode="append", each=None):
        seen["plan"] = each
        return None

    jobs.drain = drain
    try:
        jobs.incremental_plan(spark, sub, str(tmp_path), 256)
    finally:
        jobs.drain = real
    for batch, part in ((0, sub.where("sub_piece_cid < 3")), (1, sub.where("sub_piece_cid BETWEEN 3 AND 6")), (1, sub.where("sub_piece_cid BETWEEN 3 AND 6")), (3, sub.where("sub_piece_cid > 6"))):
        seen["plan"](part, batch)
    got = {r.sub_piece_cid: r.idx for r in jobs.planned(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(12)] == [0, 0, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6] and jobs.planned(spark, str(tmp_path)).count() == 12


def test_slices_are_many_files(spark, tmp_path):
    s = jobs.as_stream(spark.range(1000).withColumn("v", F.col("id")), "id", 3)
    sizes = []
    jobs.drain(s, each=lambda df, b: sizes.append((b, df.count(), df.agg(F.min("id")).first()[0])))
    assert len(sizes) == 3 and [m for _, _, m in sizes] == sorted(m for _, _, m in sizes) and sum(n for _, n, _ in sizes) == 1000


def updated(spark, stream, mode, path):
    """Rows of the state that each trigger wrote."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = stream.writeStream.format("noop").outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return [p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"]]


def test_neighbouring_batches_share_state(spark, tmp_path):
    """A call and a few rows of the state for 256 batches; it was a call for each batch, with rows and a timer for each of its times."""
    zero = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i % 2000, zero + dt.timedelta(minutes=i), "committed", i) for i in range(6000)], "batch long, ts timestamp, kind string, seq long")
    got = updated(spark, jobs.stall_watchdog(jobs.as_stream(df, "seq", 2), 3600, "20 days"), "append", tmp_path)
    assert got and max(got) < 100


def test_alarms_of_batches_without_an_id_and_below_zero(spark):
    zero = dt.datetime(2024, 1, 1)
    at = lambda m: zero + dt.timedelta(minutes=m)
    rows = [(None, 0, "parked"), (None, 90, "failed"), (-1, 10, "failed"), (-1, 70, "failed"), (-300, 0, "parked"), (-300, 60, "failed"), (0, 5, "committed"), (0, 66, "failed")]
    df = spark.createDataFrame([(b, at(m), kind, i) for i, (b, m, kind) in enumerate(rows)] + [(9, at(90_000), "parked", 100)], "batch long, ts timestamp, kind string, seq long")
    out = jobs.drain(jobs.stall_watchdog(jobs.as_stream(df, "seq", 3), 3600, "20 days")).collect()
    assert sorted(((r.batch, r.since) for r in out), key=str) == sorted([(None, at(0)), (None, at(90)), (-1, at(70)), (-300, at(60)), (0, at(5)), (0, at(66))], key=str)


def test_neighbouring_keys_share_state(spark, tmp_path):
    """A call and a row of the state for 256 keys; it was one for each key."""
    df = spark.createDataFrame([(i % 2000, i, "planned") for i in range(6000)], "key long, seq long, kind string")
    got = updated(spark, jobs.lifecycle_fold(jobs.as_stream(df, "seq", 2)), "update", tmp_path)
    assert got and max(got) < 100


def test_keys_that_are_null_or_below_zero(spark):
    rows = [(None, 0, "planned"), (-1, 1, "planned"), (-1, 2, "submitted"), (None, 3, "parked"), (0, 4, "committed"), (None, 5, "committed"), (-300, 6, "failed"), (None, 7, "failed")]
    out = jobs.drain(jobs.lifecycle_fold(jobs.as_stream(spark.createDataFrame(rows, "key long, seq long, kind string"), "seq", 2)), "update").collect()
    assert {(r.key, r.seq, r.before, r.kind) for r in out if r.status is None} == {(None, 7, "committed", "failed")}
    last = {r.key: (r.seq, r.status, r.n_illegal) for r in sorted((r for r in out if r.status is not None), key=lambda r: r["_batch"])}
    assert last == {None: (7, "committed", 1), -1: (2, "submitted", 0), 0: (4, "committed", 0), -300: (6, "failed", 0)}
