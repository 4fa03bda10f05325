"""Versions published by compare-and-set, saves that refuse, and imports by the rules."""

import pytest
from pyspark.sql import functions as F

from stowage.operators import joins
from stowage.sources.state import Refused, StaleVersion, State, save_aggregates, save_sub_pieces


def pieces(spark, *cids):
    return spark.createDataFrame([(c, f"p{c}", 10, "done", "g", "u", None, None) for c in cids], "cid string, piece_cid string, raw_size long, status string, gateway string, url string, error string, failure_category string")


def subs(spark, *rows):
    return spark.createDataFrame([(s, 10, "built", path, url, None) for s, path, url in rows], "sub_piece_cid string, raw_size long, status string, car_path string, url string, sha256 string")


def members(spark, *rows):
    return spark.createDataFrame([(s, m, i, 10, None) for i, (s, m) in enumerate(rows)], "sub_piece_cid string, member_cid string, member_sort_order long, raw_size long, sha256 string")


def listing(path):
    return sorted(p.name for p in path.iterdir())


def test_of_two_writers_the_later_one_is_refused(spark, tmp_path):
    one, other = State(spark, str(tmp_path)), State(spark, str(tmp_path))
    assert one.version() == other.version() == 0 and one.table("pieces").count() == 0
    assert one.publish(0, replace={"pieces": pieces(spark, "a")}) == 1
    before = listing(tmp_path)
    with pytest.raises(StaleVersion):
        other.publish(0, replace={"pieces": pieces(spark, "b")})
    assert listing(tmp_path) == before and [r.cid for r in other.table("pieces").collect()] == ["a"]
    assert other.publish(other.version(), append={"pieces": pieces(spark, "b")}) == 2
    assert {r.cid for r in one.table("pieces").collect()} == {"a", "b"} and [r.cid for r in one.table("pieces", 1).collect()] == ["a"]


def test_a_writer_that_saw_nothing_yet_is_refused_by_the_rename(spark, tmp_path, monkeypatch):
    """Both look before either publishes: the second's rename meets the first's folder."""
    one, other = State(spark, str(tmp_path)), State(spark, str(tmp_path))
    seen, real = [0], other.version
    monkeypatch.setattr(other, "version", lambda: seen.pop() if seen else real())
    one.publish(0, replace={"pieces": pieces(spark, "a")})
    with pytest.raises(StaleVersion):
        other.publish(0, replace={"pieces": pieces(spark, "b")})
    assert [r.cid for r in one.table("pieces").collect()] == ["a"] and len(listing(tmp_path)) == 1


def test_an_append_writes_its_rows_only(spark, tmp_path):
    state = State(spark, str(tmp_path))
    state.publish(0, replace={"pieces": pieces(spark, *map(str, range(50)))})
    state.publish(1, append={"pieces": pieces(spark, "x")})
    parts = [p for p in (tmp_path / "v-000000000002").iterdir() if p.name.startswith("pieces")]
    assert len(parts) == 1 and spark.read.parquet(str(parts[0])).count() == 1 and state.table("pieces").count() == 51


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    state = State(spark, str(tmp_path))
    bad = pieces(spark, "a").withColumn("cid", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        state.publish(0, replace={"pieces": bad})
    with pytest.raises(Refused, match="lacks"):
        state.publish(0, replace={"pieces": pieces(spark, "a").drop("url")})
    assert listing(tmp_path) == [] and state.version() == 0


def test_sub_pieces_and_members_land_together_or_not_at_all(spark, tmp_path):
    state = State(spark, str(tmp_path))
    state.publish(0, replace={"pieces": pieces(spark, "a", "b")})
    good, both = subs(spark, ("s", "/x.car", None)), members(spark, ("s", "a"), ("s", "b"))
    for sub, member, why in [
        (good, members(spark, ("s", "a"), ("s", "c")), "member_cid c is unknown"),
        (good, members(spark, ("s", "a"), ("t", "b")), "sub_piece_cid t is unknown"),
        (subs(spark, ("s", "/x.car", "http://u")), both, "not both"),
        (subs(spark, ("s", None, "")), both, "not both"),
        (good.union(good), both, "comes twice"),
        (good, both.union(both), "comes twice"),
    ]:
        with pytest.raises(Refused, match=why):
            save_sub_pieces(state, 1, sub, member)
        assert state.version() == 1 and state.table("sub_pieces").count() == 0
    assert save_sub_pieces(state, 1, good, both) == 2
    with pytest.raises(Refused, match="is there already"):
        save_sub_pieces(state, 2, good, both)
    with pytest.raises(StaleVersion):
        save_sub_pieces(state, 1, subs(spark, ("t", "/t", None)), members(spark, ("t", "a")))
    assert [(r.member_cid, r.member_sort_order) for r in state.table("sub_piece_members").orderBy("member_sort_order").collect()] == [("a", 0), ("b", 1)]


def test_aggregates_refuse_unknown_members(spark, tmp_path):
    state = State(spark, str(tmp_path))
    state.publish(0, replace={"sub_pieces": subs(spark, ("s", "/x", None))})
    aggs = spark.createDataFrame([(0, "r", 128, "planned", None, None, None)], "idx long, root_piece_cid string, piece_size long, status string, tx_hash string, error string, committed_block long")
    held = lambda *xs: spark.createDataFrame([(0, i, x) for i, x in enumerate(xs)], "aggregate_idx long, segment_index long, sub_piece_cid string")
    with pytest.raises(Refused, match="t is unknown"):
        save_aggregates(state, 1, aggs, held("s", "t"))
    with pytest.raises(Refused, match="belong together"):
        save_aggregates(state, 1, aggs, held())
    assert state.version() == 1 and save_aggregates(state, 1, aggs, held("s")) == 2 and state.table("aggregates").count() == 1


def test_import_rules(spark):
    state = spark.createDataFrame([("d", "pd", 10, "done"), ("o", "po", 10, "oversized"), ("w", "pw", 10, "pending"), ("f", None, None, "failed")], "cid string, piece_cid string, raw_size long, status string")
    plan = lambda *rows: {r.cid: (r.plan, r.reason) for r in joins.import_plan(spark.createDataFrame(rows, "cid string, piece_cid string, raw_size long"), state, spark.createDataFrame([("sub",)], "sub_piece_cid string")).collect()}
    got = plan(("d", "pd", 10), ("o", "po", 10), ("w", "px", 9), ("f", "pf", 1), ("n", "pn", 1), ("m", "sub", 1))
    assert {k: v[0] for k, v in got.items()} == {"d": "recorded", "o": "recorded", "w": "upgrade", "f": "upgrade", "n": "new", "m": "conflict"}
    got = plan(("d", "pd", 99), ("o", "px", 10))
    assert got["d"] == ("conflict", "recorded as pd (10 bytes), the manifest says pd (99 bytes)") and got["o"][0] == "conflict"
    # a commitment that another piece has, and no sub-piece, is no conflict
    assert plan(("n", "pd", 10))["n"][0] == "new"


def test_a_refused_import_changes_nothing_and_a_second_one_neither(spark):
    state = spark.createDataFrame([("o", "po", 10, "oversized", None), ("w", None, None, "failed", "other")], "cid string, piece_cid string, raw_size long, status string, failure_category string")
    none = spark.createDataFrame([], "sub_piece_cid string")
    manifest = lambda *rows: spark.createDataFrame(rows, "cid string, piece_cid string, raw_size long")
    rows = lambda df: sorted(tuple(r) for r in df.select("cid", "piece_cid", "raw_size", "status", "failure_category").collect())
    assert rows(joins.apply_import(manifest(("o", "po", 11), ("w", "pw", 1)), state, none, "https://g")) == rows(state)
    once = joins.apply_import(manifest(("o", "po", 10), ("w", "pw", 1), ("n", "pn", 2)), state, none, "https://g/")
    assert rows(once) == [("n", "pn", 2, "done", None), ("o", "po", 10, "oversized", None), ("w", "pw", 1, "done", "other")]
    assert rows(joins.apply_import(manifest(("o", "po", 10), ("w", "pw", 1), ("n", "pn", 2)), once, none, "https://g/")) == rows(once)
    assert once.where("cid = 'n'").first().url.startswith("https://g/ipfs/n?format=car")
