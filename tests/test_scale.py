"""What travels: rows shuffled and written grow with the tables, not with what they spell out."""

import pytest
from pyspark.sql import functions as F

from stowage import fixtures as fx
from stowage.operators import joins, merkle, windows
from stowage.plans.graphs import depth_first
from stowage.plans.primitives import cut
from stowage.queries import QUERIES


@pytest.fixture
def moved(spark):
    """Rows that tasks shuffled and wrote to tables since the last call."""
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    seen = set()

    def run():
        stages, rows = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None).iterator(), 0
        while stages.hasNext():
            s = stages.next()
            if (s.stageId(), s.attemptId()) not in seen:
                seen.add((s.stageId(), s.attemptId()))
                rows += s.shuffleWriteRecords() + s.outputRecords()
        return rows

    run()
    return run


def shared(spark, aggregates, size):
    """Aggregates of two sub-pieces, 0 with many source ids and one of its own with one."""
    members = spark.range(aggregates).select(F.col("id").alias("aggregate_idx"), F.posexplode(F.array(F.lit(0).cast("long"), F.col("id") + 1)).alias("segment_index", "sub_piece_cid"))
    sub_members = spark.range(size).select(F.lit(0).cast("long").alias("sub_piece_cid"), F.col("id").alias("member_cid"), (F.col("id") * 3).alias("member_sort_order"))
    own = spark.range(aggregates).select((F.col("id") + 1).alias("sub_piece_cid"), (F.col("id") + size).alias("member_cid"), F.lit(0).cast("long").alias("member_sort_order"))
    return members, cut(sub_members.union(own))


def test_a_walk_is_not_spelled_out(spark, moved):
    members, sub_members = shared(spark, 400, 500)
    places = [(a, m) for a in range(400) for m in [*range(500), 500 + a]]  # 200,400 memberships
    moved()
    segments = cut(windows.walk(members, sub_members))
    got = {(r.aggregate_idx, r.member_cid, r.idx) for r in windows.stride_members(segments, sub_members, 37).collect()}
    assert got == {(*places[i * len(places) // 37], i * len(places) // 37) for i in range(37)}
    n = windows.n_members(segments, sub_members)
    got = {(r.aggregate_idx, r.member_cid, r.idx) for r in windows.nested_sample(segments, sub_members, n, 41.7).collect()}
    assert n == 900 and got == {(*places[int(i * (900 / 41))], int(i * (900 / 41))) for i in range(41)}
    assert moved() < 20_000
    for whole in (900, 1e9, float("inf"), float("nan")):
        assert windows.nested_sample(segments, sub_members, n, whole).count() == 900
    assert windows.nested_sample(segments, sub_members, n, 0.5).count() == windows.stride_members(segments, sub_members, 0).count() == 0
    assert windows.stride_members(segments, sub_members, 10**6).count() == len(places)


def test_assets_are_spelled_out_last(spark, moved):
    members, sub_members = shared(spark, 400, 500)
    moved()
    df = joins.aggregate_assets(members, sub_members)
    df.write.format("noop").mode("overwrite").save()
    assert moved() < 220_000  # the rows that come out, and little more
    got = {(r.aggregate_idx, r.place, r.member_cid) for r in df.where("aggregate_idx IN (0, 399)").collect()}
    assert got == {(a, i, m) for a in (0, 399) for i, m in enumerate([*range(500), 500 + a])}


def test_members_of_trees_travel_once(spark, moved):
    rows = spark.range(40_000).select((F.col("id") % 10_000).alias("key"), F.expr("id div 10000").alias("order"), F.expr("int(id % 3)").alias("height"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("node"), F.lit(127).cast("long").alias("raw_size"), "id")
    kept = merkle.digested_roots(rows.where("key % 2 = 0")).withColumn("root", F.when(F.col("key") % 4 == 0, "kept").otherwise(F.col("root")))
    kept = cut(kept.withColumn("digest", F.when(F.col("key") % 6 == 0, "changed").otherwise(F.col("digest"))))
    moved()
    got = {r.key: (r.root, r.replayed) for r in merkle.replayed_roots(rows, kept).collect()}
    assert moved() < 60_000  # members and kept roots once
    want = {r.key: r.root for r in merkle.aggregate_roots(rows).collect()}
    assert moved() < 45_000
    stands = lambda k: k % 2 == 0 and k % 6 != 0
    assert len(got) == 10_000 and all(got[k] == ("kept" if stands(k) and k % 4 == 0 else want[k], not stands(k)) for k in got)


def test_shallow_trees_take_few_rounds(spark, moved):
    n = 20_000
    links = spark.range(1, n).select(F.expr("(id - 1) div 10").alias("parent"), F.col("id").alias("link_index"), F.col("id").alias("child"))
    moved()
    df = depth_first(links, spark.createDataFrame([(0, 0)], "root long, node long"))
    got = {r.node: (r.place, r.depth) for r in df.collect()}
    assert moved() < 25 * n
    place, stack = 0, [(0, 0)]
    while stack:
        node, depth = stack.pop()
        assert got.pop(node) == (place, depth)
        place += 1
        stack += [(c, depth + 1) for c in range(min(n - 1, node * 10 + 10), node * 10, -1)]
    assert not got


@pytest.mark.parametrize("name", ["dg3_dag_order", "dg4_missing_blocks", "dg5_dag_stats"])
def test_block_graph_queries_move_links_few_times(spark, moved, sf_dir, name):
    links = fx.links(spark, sf_dir).count()
    moved()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    assert moved() < 9 * links
