"""What the pipeline's stages decide, against brute force."""

import itertools

import corpus_pipeline
import pytest
from stowage.llm import minhash_dedup, mixing
from stowage.llm.common import cut, read

from .test_operators import brute_sets


def brute_kept(docs, percent):
    """The doc_ids that are the least of their group of near copies."""
    sets = brute_sets((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    root = {i: i for i in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return sorted(i for i in sets if top(i) == i)


def edited(n, changed):
    """A text of n shingles, of which a changed word touches five."""
    words = [f"w{n}x{i}" for i in range(n + 4)]
    return " ".join(words[: n // 2] + ["changed"] + words[n // 2 + 1 :] if changed else words)


def test_near_copies_at_80_percent_go(spark, sf_dir):
    rows = [(100_000 + 2 * n + c, edited(n, c)) for n in (44, 45, 50, 56, 80) for c in (0, 1)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(own)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).select("doc_id").distinct().collect())
    assert got == brute_kept(docs, 80)
    assert [i - 100_000 for i in got if i >= 100_000] == [88, 89, 90, 100, 112, 160]


def test_matches_follow_the_percent():
    assert [minhash_dedup.matches(p) for p in (50, 80, 85, 100)] == [2, 12, 15, 32]


def test_the_mix_reaches_the_result(spark, sf_dir, monkeypatch):
    docs = read(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    mixed = cut(stages["source_mixing"](spark, docs, sf_dir))
    got = stages["byte_bpe"](spark, mixed, sf_dir).select("doc_id", "slot", "place").collect()
    want = sorted(mixing.mixed(docs).collect(), key=lambda r: (r.slot, r.place))
    assert [tuple(r) for r in got] == [(r.doc_id, r.slot, r.place) for r in want]
    few = cut(mixing.in_mix_order(docs, min_block=1))
    assert [r.doc_id for r in stages["byte_bpe"](spark, few, sf_dir).collect()] != [r.doc_id for r in want]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] in ("minhash_near_dedup", "byte_bpe")])
    with pytest.raises(ValueError):
        corpus_pipeline.run(spark, sf_dir)
