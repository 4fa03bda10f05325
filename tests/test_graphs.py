"""Depth-first order against recursion: shared nodes, deep chains, one parent with most of the children."""

import random

import pytest
from pyspark.sql import functions as F

from stowage.plans import graphs
from stowage.plans.graphs import depth_first


def plain(links, roots):
    children = {}
    for p, i, c in sorted(links):
        children.setdefault(p, []).append(c)
    out = set()
    for root, node in roots:
        seen, stack = {}, [(node, 0)]
        while stack:
            v, depth = stack.pop()
            if v in seen:
                continue
            seen[v] = (len(seen), depth)
            stack += [(c, depth + 1) for c in reversed(children.get(v, []))]
        out |= {(root, v, place, depth) for v, (place, depth) in seen.items()}
    return out


def order(spark, links, roots):
    df = depth_first(spark.createDataFrame(links, "parent string, link_index long, child string"), spark.createDataFrame(roots, "root string, node string"))
    return {(r.root, r.node, r.place, r.depth) for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_shared_nodes(spark, many_tasks, seed):
    rng = random.Random(seed)
    links = []
    for p in range(60):
        kids = [rng.randrange(p + 1, 80) for _ in range(rng.choice([0, 1, 2, 4]))]
        links += [(f"v{p}", i, f"v{c}") for i, c in enumerate(kids)]  # a child may come twice
    roots = [("a", "v0"), ("b", "v3"), ("c", "v0"), ("d", "v79")]  # one below another, one twice, one without children
    assert order(spark, links, roots) == plain(links, roots)


def test_a_chain_of_many_thousand_nodes(spark):
    n = 100_000
    links = spark.range(n - 1).select(F.col("id").alias("parent"), F.lit(0).cast("long").alias("link_index"), (F.col("id") + 1).alias("child"))
    got = depth_first(links, spark.createDataFrame([(0, 0)], "root long, node long"))
    assert got.where("place <> node OR depth <> node").count() == 0 and got.count() == n


def test_one_parent_of_most(spark, many_tasks):
    links = [("r", i, f"c{i}") for i in range(3000)] + [("c7", 0, "x"), ("c5", 0, "x"), ("x", 0, "y")]
    assert order(spark, links, [("r", "r")]) == plain(links, [("r", "r")])


def test_nothing_and_circles(spark):
    assert order(spark, [], [("r", "r")]) == {("r", "r", 0, 0)}
    assert order(spark, [("a", 0, "b")], []) == set()


def layered(rng, width, depth):
    """Links of layers, shared below, some over two layers, with numbers of one to sixteen hex digits."""
    numbers = [0, 9, 10, 15, 16, 17, 255, 256, 4095, 4096, 1 << 40, (1 << 63) - 1, -1, -17]
    links = []
    for at in range(depth):
        for p in range(width):
            below = [(at + 1 + (at + 2 <= depth and rng.random() < 0.3), rng.randrange(width)) for _ in range(rng.choice([0, 2, 5]))]
            links += [(f"v{at}.{p}", i, f"v{a}.{c}") for i, (a, c) in zip(rng.sample(numbers, len(below)), below)]
    return links, [(f"r{p}", f"v0.{p}") for p in range(width)] + [("again", "v0.1"), ("below", "v2.3")]


@pytest.mark.parametrize("shallow", [0, 3, 4])
def test_both_ways_give_one_order(spark, many_tasks, monkeypatch, shallow):
    monkeypatch.setattr(graphs, "SHALLOW", shallow)  # graphs of four layers: trees, trees, and a level at a time
    links, roots = layered(random.Random(shallow), 12, 4)
    want = plain(links, roots)
    assert order(spark, links, roots) == want and max(depth for *_, depth in want) > 2
    kept = graphs.by_parent(spark.createDataFrame(links, "parent string, link_index long, child string"))
    begun = spark.createDataFrame(roots, "root string, node string")
    assert sorted(map(tuple, graphs.reached(kept, begun).collect())) == sorted((r, v) for r, v, _, _ in want)
    assert {(r.root, r.node, r.depth) for r in graphs.first_visits(kept, begun).collect()} == {(r, v, depth) for r, v, _, depth in want}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("links_")]
