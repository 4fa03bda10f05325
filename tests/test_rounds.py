"""Rounds: repeated ones change nothing, killed ones leave nothing, and nothing is added twice."""

import pytest
from pyspark.sql import functions as F

from stowage.plans.rounds import run_round
from stowage.sources.state import StaleVersion, State

AGG = "idx long, root_piece_cid string, piece_size long, status string, tx_hash string, error string, committed_block long"


def start(spark, path, *rows):
    """Aggregates of two sub-pieces each: 10 * idx and 10 * idx + 1."""
    state = State(spark, str(path))
    aggs = spark.createDataFrame([(i, None, 0, status, tx, None, None) for i, status, tx in rows], AGG)
    members = spark.createDataFrame([(i, k, str(10 * i + k)) for i, *_ in rows for k in (0, 1)], "aggregate_idx long, segment_index long, sub_piece_cid string")
    subs = members.select("sub_piece_cid", F.lit(100).alias("raw_size"), F.lit("built").alias("status"), F.lit("/x").alias("car_path"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("sha256"))
    state.publish(0, replace={"aggregates": aggs, "aggregate_members": members, "sub_pieces": subs})
    return state


def says(spark, cap=10, ledger=(), events=(), pulls=(), adds=(), fee=1, floor=0):
    make = spark.createDataFrame
    return (cap, make([(1, 0, fee)], "event_id long, ts long, fee long"), make([(x,) for x in ledger], "root long"), make(list(events), "tx string, piece_ids array<long>, roots array<long>"), make(list(pulls), "sub_piece_cid string, state string"), make(list(adds), "idx long, tx string"), floor)


def rows(state, version=None):
    return {r.idx: (r.status, r.tx_hash, r.error) for r in state.table("aggregates", version).collect()}


def test_a_whole_life_in_rounds(spark, tmp_path):
    state = start(spark, tmp_path, (1, "planned", None), (2, "planned", None), (3, "committed", "0x3"))
    done = [(str(10 * i + k), "complete") for i in (1, 2) for k in (0, 1)]
    assert run_round(state, 1, 1, *says(spark, pulls=done[:3] + [("21", "failed")])) == 2
    assert rows(state) == {1: ("parked", None, None), 2: ("failed", None, "pull failed for 1 sub-pieces"), 3: ("committed", "0x3", None)}
    assert run_round(state, 2, 2, *says(spark, adds=[(1, "0x1"), (2, "0x2")])) == 3 and rows(state)[1] == ("parked", "0x1", None)
    assert run_round(state, 3, 3, *says(spark, adds=[(1, "0xother")])) == 4 and rows(state)[1] == ("parked", "0x1", None)  # it waits, and is never added again
    assert run_round(state, 4, 4, *says(spark, ledger=[1], events=[("0x1", [7], [1])])) == 5 and rows(state)[1] == ("committed", "0x1", None)
    log = state.table("pull_batch_attempts").collect()
    assert sorted((r.aggregate_idx, r.piece_cids, r.result) for r in log) == [(1, ["10", "11"], "2/0"), (2, ["20", "21"], "1/1")]
    totals = {r["round"]: (r.committed, r.failed, r.bytes) for r in state.table("rounds").collect()}
    assert totals == {1: (0, 1, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (1, 0, 200)}


def test_a_killed_round_is_repeated_and_a_published_one_is_not(spark, tmp_path, monkeypatch):
    state = start(spark, tmp_path, (1, "planned", None), (2, "planned", None))
    given = says(spark, pulls=[("10", "complete"), ("11", "complete")])
    real = State._rename
    monkeypatch.setattr(State, "_rename", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        run_round(state, 1, 1, *given)
    monkeypatch.setattr(State, "_rename", real)
    assert state.version() == 1 and rows(state) == {1: ("planned", None, None), 2: ("planned", None, None)} and [p.name for p in tmp_path.iterdir()] == ["v-000000000001"]
    assert run_round(state, 1, 1, *given) == 2
    want = rows(state)
    assert want == {1: ("parked", None, None), 2: ("submitted", None, None)}
    assert run_round(state, 2, 1, *given) == 2 and rows(state) == want and state.table("pull_batch_attempts").count() == 2
    with pytest.raises(StaleVersion):
        run_round(state, 1, 1, *given)


def test_floor_cap_and_fees_hold_back(spark, tmp_path):
    state = start(spark, tmp_path, *[(i, "planned", None) for i in range(1, 5)])
    assert run_round(state, 1, 1, *says(spark, cap=2)) == 2
    assert [s for s, *_ in rows(state).values()].count("submitted") == 2 and rows(state)[1][0] == "submitted"
    assert run_round(state, 2, 2, *says(spark, cap=10, fee=10**9)) == 3 and [s for s, *_ in rows(state).values()].count("submitted") == 2
    assert run_round(state, 3, 3, *says(spark, cap=10, floor=256)) == 4
    assert {i: s for i, (s, _, _) in rows(state).items()} == {1: "submitted", 2: "submitted", 3: "failed", 4: "failed"} and "below the floor of 256" in rows(state)[4][2]


def test_lines_are_placed_once(spark, sf_dir, monkeypatch):
    """The state and the events of both rounds are of one table of members; each sorted all lines for itself."""
    from stowage import fixtures
    from stowage.plans import rounds as module

    calls, real = [], fixtures.aggregate_members
    monkeypatch.setattr(fixtures, "aggregate_members", lambda *a: calls.append(a) or real(*a))
    module.job7_two_rounds(spark, sf_dir)
    assert len(calls) == 1
