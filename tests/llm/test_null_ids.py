"""Rows without a doc_id: each is a document of its own."""

import pytest

import corpus_pipeline
from stowage.llm import minhash_dedup, suffix_dedup

from .conftest import SCHEMA, odd_texts, sentence


@pytest.fixture(scope="module")
def rows():
    """Odd texts with ids, and without one: a text alone, one twice, a copy of a text with an id, and no text."""
    import random

    rng = random.Random(11)
    alone, twice, copy = sentence(rng, 80), sentence(rng, 80), odd_texts()[6]
    given = [(i + 100, t) for i, t in enumerate(odd_texts())]
    return given, [(None, t) for t in (alone, twice, twice, copy, None)]


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", None, "b", None, 1, 2) for i, t in pairs], SCHEMA).repartition(3)


def test_near_duplicates(spark, rows):
    given, without = rows
    got = minhash_dedup.near_duplicates(frame(spark, given + without)).collect()
    with_ids = minhash_dedup.near_duplicates(frame(spark, given)).collect()
    assert sorted(map(tuple, (r for r in got if r.doc_id is not None))) == sorted(map(tuple, with_ids))
    own = sorted((r.component_id or -1, r.kept, r.n_shingles) for r in got if r.doc_id is None)
    assert own == [(-1, False, 76), (-1, True, 0), (-1, True, 76), (-1, True, 76), (106, False, 296)]


def test_repeats(spark, rows):
    given, without = rows
    numbered = frame(spark, given + [(900 + i, t) for i, (_, t) in enumerate(without)])
    want = sorted(tuple(r) for r in suffix_dedup.remove_repeats(numbered).collect() if r.doc_id < 900)
    own = sorted(tuple(r[1:]) for r in suffix_dedup.remove_repeats(numbered).collect() if r.doc_id >= 900)
    got = suffix_dedup.remove_repeats(frame(spark, given + without)).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert sorted(tuple(r[1:]) for r in got if r.doc_id is None) == own
    assert sum(n_removed > 0 for _, n_removed, *_ in own) == 3


def test_the_stage_keeps_one_of_each(spark, rows, sf_dir):
    given, without = rows
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, given + without), sf_dir)
    texts = sorted(r.text or "" for r in out.where("doc_id IS NULL").collect())
    assert texts == sorted(["", without[0][1], without[1][1]])
    for _, stage in corpus_pipeline.STAGES[2:]:
        out = stage(spark, out, sf_dir)
    assert sum(r.doc_id is None for r in out.collect()) == 3
