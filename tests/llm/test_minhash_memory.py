"""Sets are counted by ranges of values, and texts signed in portions, without a change of the result."""

import numpy as np
import pyarrow as pa

from stowage.llm import minhash_dedup as m


def test_ranges_of_values_add_up(monkeypatch):
    rng = np.random.default_rng(7)
    pool = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    pool[0], pool[1] = 0, (1 << 64) - 1
    draw = lambda n: [np.unique(rng.choice(pool, rng.integers(0, 120))) for _ in range(n)]
    left, right = [*draw(9), np.zeros(0, np.uint64), pool[:2].copy()], [*draw(7), pool[:2].copy()]
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    for compared in (1 << 20, 100, 7):
        monkeypatch.setattr(m, "COMPARED", compared)
        assert m._overlaps(left, right).tolist() == want


def test_portions_are_the_whole_batch():
    texts = ["a b c d e f" * k if k % 5 else None for k in range(40)] + ["x y z " * 400_000, "", "one two three four five six"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(m._portions(iter([batch.slice(0, 0), batch, batch.slice(3, 4)])))
    assert [x for p in parts for x in p.column("doc_id").to_pylist()] == [*range(len(texts)), 3, 4, 5, 6]
    assert all(len(p) == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 1 << 20 for p in parts)
    signed = pa.Table.from_batches(m._signatures(iter([batch])))
    alone = pa.Table.from_batches([b for i in range(len(texts)) for b in m._signatures(iter([batch.slice(i, 1)]))])
    assert signed.to_pydict() == alone.to_pydict()


def test_skipped_lists_lose_no_pair():
    """What merging finds by the short lists and looking up in the long ones is what counting every coordinate finds."""
    rng = np.random.default_rng(3)
    for least in (1, 5, 12, 15, 31, 32):
        base = rng.integers(0, 1 << 40, (6, m.COORDINATES))
        rows = base[rng.integers(0, 6, 60)].copy()
        change = rng.random(rows.shape) < rng.random((60, 1))
        rows[change] = rng.integers(0, 1 << 40, int(change.sum()))
        rows[:, 3] = 7  # a list that all are in
        rows = rows.astype(np.int64)
        left, right = rows[:25], rows[10:]
        assert (m.retained(left, right, least) == (m.collisions(left, right) >= least)).all()
        assert m.retained(left[:0], right, least).shape == (0, len(right))


def test_a_part_makes_its_hub_once(monkeypatch):
    """Members of several hubs in one stream, cut into portions anywhere."""
    words = [f"w{i}" for i in range(200)]
    edit = lambda k, at: " ".join(f"e{k}" if i in at else w for i, w in enumerate(words))
    texts = {1: edit(0, ()), 2: edit(2, (50,)), 3: edit(3, range(0, 200, 5)), 4: "other " + edit(0, range(0, 200, 3)), 5: edit(5, (1, 190))}
    signed = {r["doc_id"]: r["pairs"] for r in pa.Table.from_batches(m._signatures(iter([pa.RecordBatch.from_pydict({"doc_id": list(texts), "text": list(texts.values())})]))).to_pylist()}
    rows = [(h, i, i != h) for h in (1, 3) for i in [h, *(k for k in texts if k != h)]]
    batch = pa.RecordBatch.from_pydict({"hub": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "member": [r[2] for r in rows], "pairs": [signed[r[1]] for r in rows], "text": [texts[r[1]] for r in rows]})
    made = []
    real = m._sets
    monkeypatch.setattr(m, "_sets", lambda t: made.extend(t.to_pylist()) or real(t))
    for batches in ([batch], [batch.slice(i, 1) for i in range(len(rows))], [batch.slice(0, 3), batch.slice(3)]):
        made.clear()
        got = pa.Table.from_batches(m._star(85, 15)(iter(batches))).to_pylist()
        assert {(r["hub"], r["doc_id"]) for r in got if r["linked"]} == {(1, 2), (1, 5)} and len(got) == 8
        assert made.count(texts[3]) <= 2  # as a hub, and as a member of the other
