"""Queries against brute force over the whole tables, beside their SQL, on sf0.001."""

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stowage.fixtures import SEGMENT_ORDER
from stowage.functions.columns import format_duration
from stowage.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{SF_DIR}/{name}.parquet").to_pylist()


def graph():
    kids = defaultdict(set)
    for r in table("nation"):
        kids[f"r{r['n_regionkey']}"].add((r["n_nationkey"], f"n{r['n_nationkey']}"))
    for r in table("customer"):
        kids[f"n{r['c_nationkey']}"].add((r["c_custkey"], f"c{r['c_custkey']}"))
    orders = set()
    for r in table("orders"):
        orders.add(r["o_orderkey"])
        kids[f"c{r['o_custkey']}"].add((r["o_orderkey"], f"o{r['o_orderkey']}"))
    for r in table("lineitem"):
        if r["l_orderkey"] in orders:
            kids[f"o{r['l_orderkey']}"].add((r["l_partkey"], f"p{r['l_partkey']}"))
    return {p: [c for _, c in sorted(x)] for p, x in kids.items()}


def part_of(node):
    return int(node[1:]) if node[0] == "p" else 1


def block_graph():
    kids = graph()
    nodes = {c for x in kids.values() for c in x}
    there = {n for n in nodes if part_of(n) % 13}
    good = {n for n in there if part_of(n) % 17}
    order = {}
    for root in sorted(p for p in kids if p not in nodes):
        seen, depth, stack = {}, {}, [(root, 0)]
        while stack:
            node, k = stack.pop()
            if node not in seen:
                seen[node], depth[node] = len(seen), k
                stack += [(c, k + 1) for c in reversed(kids.get(node, []))]
        order[root] = seen, depth
    first = {}
    for p, x in kids.items():
        for i, c in enumerate(x):
            first[p[0], c] = min(i, first.get((p[0], c), i))
    size = lambda n: (len(n) + (n not in good)) * (n in there)
    return {
        "dg1_verify_blocks": {(n, n in good) for n in there},
        "dg2_dedupe_blocks": {(*k, v) for k, v in first.items()},
        "dg3_dag_order": {(r, n, i) for r, (seen, _) in order.items() for n, i in seen.items()},
        "dg4_missing_blocks": {(r, len(seen.keys() - there - {r})) for r, (seen, _) in order.items()},
        "dg5_dag_stats": {(r, len(seen), sum(map(size, seen)), max(depth.values())) for r, (seen, depth) in order.items()},
        "dg6_declared_roots": {(p, None if "p" + p[1:] in x else "car_root_mismatch") for p, x in kids.items()},
        "fn2_raw_block_url": {(n, f"https://g/ipfs/{n}?format=raw") for n in there},
        "pk7_validate_members": {(p, not set(x) - good, tuple(sorted(set(x) - good))) for p, x in kids.items()},
        "jn18_gap_fill": {(n, "primary" if n in good else "fallback" if n.endswith("1") else "unresolved") for n in nodes},
    }


def assets():
    segments, members = defaultdict(list), defaultdict(set)
    for r in table("lineitem"):
        segments[r["l_orderkey"]].append((tuple(r[c] for c in SEGMENT_ORDER), r["l_partkey"]))
        members[r["l_partkey"]].add(r["l_suppkey"])
    out = [(k, [m for _, p in sorted(x) for m in sorted(members[p])]) for k, x in sorted(segments.items())]
    roots = {r["o_orderkey"] for r in table("orders") if r["o_orderkey"] % 5 < 3}
    on = [(k, m) for k, x in out if k in roots for m in x]
    ids, suppliers = {m for _, m in on}, {r["s_suppkey"] for r in table("supplier")}
    return {
        "jn5_aggregate_assets": {(k, i, m) for k, x in out for i, m in enumerate(x)},
        "wn2_stride_sample_members_whole": {(*on[i * len(on) // 25], i * len(on) // 25) for i in range(25)},
        "ag5_committed_stats": {(len(ids), sum(m in suppliers and m % 3 != 0 for m in ids))},
    }


def fixed(x, digits):
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def duration(ms):
    return f"{ms}ms" if ms < 1000 else fixed(ms / 1000, 1) + "s"


def formats():
    size = lambda n: f"{fixed(n / 1048576, 2)} MiB" if n >= 1048576 else f"{fixed(n / 1024, 2)} KiB" if n >= 1024 else f"{n} B"
    sizes = [(r["doc_id"], len((r["text"] or "").encode())) for r in table("documents")]
    return {"fn6_format": {(i, size(n), duration(n)) for i, n in sizes}}


@pytest.mark.parametrize("make", [block_graph, assets, formats])
def test_whole(spark, make):
    for name, want in make().items():
        got = [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in QUERIES[name](spark, SF_DIR).collect()]
        assert len(got) == len(want) and set(got) == want, name


def test_durations_round_as_the_reference_does(spark):
    ms = [999, 1000, 1050, 1250, 1450, 3350, 4750, 65950, 1234567, 3600250, 98765432150]
    df = spark.createDataFrame([(x,) for x in ms], "ms long")
    assert [r[0] for r in df.select(format_duration(F.col("ms"))).collect()] == [duration(x) for x in ms]
    assert (duration(1250), duration(1450), duration(3350)) == ("1.3s", "1.4s", "3.4s")
