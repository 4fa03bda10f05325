"""Near-duplicate documents by a signature-coordinate inverted join.

Each text has a MinHash signature over its five-word shingles. Texts are posted
under (coordinate, value) pairs, rarest pair first: two signatures that agree in
at least m = matches(percent) of COORDINATES coordinates share a pair among the
first COORDINATES - m + 1 of either (prefix merging), so the common pairs, which
make the long lists, are mostly skipped. The texts of a list meet at its hub,
the text whose pairs are the most common. There the lists are merged again,
shortest first; long ones are skipped, and only looked up for the pairs of texts
that met. Pairs that collide m times or more are retained and confirmed on full
sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, with_keys
from .textbytes import flat, mix, shingle_sets, slices

#: Signature length, and the chance at most with which a pair just at the similarity agrees in too few coordinates.
COORDINATES, MISS = 32, 1e-7
#: Linked when 100 * |intersection| >= PERCENT * |union|.
PERCENT = 85
#: Groups beyond this many texts are compared in blocks of at most this size.
BLOCK = 256
#: Values of all sets that are compared at a time.
COMPARED = 1 << 20


def matches(percent: int) -> int:
    """The least agreement of a candidate pair: as many coordinates as a pair at percent misses with a chance below MISS."""
    p, missed, m = percent / 100, 0.0, 0
    while m < COORDINATES:
        missed += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if missed >= MISS:
            break
        m += 1
    return max(m, 1)


_XOR = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_MUL = mix(_XOR) | np.uint64(1)
_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, pairs array<long>"


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of whole texts of about a megabyte, so that a task never holds the sets of all texts of a batch."""
    for batch in batches:
        for first, _, offsets in slices(*flat(batch.column("text"))):
            yield batch.slice(first, len(offsets) - 1)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _portions(batches):
        with np.errstate(over="ignore"):
            sets = shingle_sets(batch.column("text"))
            n = np.array([len(s) for s in sets], dtype=np.int64)
            keys = np.zeros((2, len(sets)), dtype=np.uint64)
            pairs = np.zeros((len(sets), COORDINATES), dtype=np.uint64)
            full = np.flatnonzero(n)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                keys[0, full], keys[1, full] = np.add.reduceat(every, at), np.add.reduceat(mix(every + np.uint64(1)), at)
                for j in range(COORDINATES):
                    x = (every ^ _XOR[j]) * _MUL[j]
                    pairs[full, j] = mix(np.minimum.reduceat(x ^ (x >> np.uint64(32)), at) + _XOR[j])
        sizes = np.where(n > 0, COORDINATES, 0)
        values = pa.array(pairs[full].reshape(-1).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *(pa.array(k.view(np.int64)) for k in keys), lists], ["doc_id", "n_shingles", "set_a", "set_b", "pairs"])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|intersection| of each left set with each right set; sets are sorted, and ranges of values are taken one after another where there are many."""
    ranges = sum(map(len, left + right)) // COMPARED + 1
    if ranges == 1:
        return _overlaps_within(left, right)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    tops = [np.uint64(((i + 1) << 64) // ranges - 1) for i in range(ranges)]
    at_left, at_right = np.zeros(len(left), dtype=np.int64), np.zeros(len(right), dtype=np.int64)
    for top in tops:
        to_left, to_right = (np.array([np.searchsorted(s, top, side="right") for s in side]) for side in (left, right))
        out += _overlaps_within([s[a:b] for s, a, b in zip(left, at_left, to_left)], [s[a:b] for s, a, b in zip(right, at_right, to_right)])
        at_left, at_right = to_left, to_right
    return out


def _overlaps_within(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """|intersection| of each left set with each right set, by a product of 0/1 matrices over the values that both sides have."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    rows_a, rows_b = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    at_a, at_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    at_a[at_a == len(shared)] = 0
    at_b[at_b == len(shared)] = 0
    in_a, in_b = (shared[at_a] == a, shared[at_b] == b) if len(shared) else (np.zeros(len(a), bool), np.zeros(len(b), bool))
    at_a, rows_a, at_b, rows_b = at_a[in_a], rows_a[in_a], at_b[in_b], rows_b[in_b]
    for start in range(0, len(shared), 4096):
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        pick = (at_a >= start) & (at_a < start + 4096)
        x[rows_a[pick], at_a[pick] - start] = 1
        pick = (at_b >= start) & (at_b < start + 4096)
        y[rows_b[pick], at_b[pick] - start] = 1
        out += x @ y.T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    if not left or not right:
        return np.zeros((len(left), len(right)), dtype=bool)
    both = _overlaps(left, right).astype(np.int64)
    either = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - both
    return (100 * both >= percent * either) & (either > 0)


def _links(ids_a, ids_b, linked: np.ndarray) -> pd.DataFrame:
    """A spanning set of the links of one block: it joins the same texts as all of them."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = int(ids_a[i]), int(ids_b[j])
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def collisions(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many coordinates each signature of left agrees with each of right."""
    out = np.zeros((len(left), len(right)), dtype=np.int16)
    for j in range(COORDINATES):
        out += left[:, j, None] == right[None, :, j]
    return out


def retained(left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """Which signatures of left and right collide in at least `least` coordinates.

    The lists of coordinate-value pairs are merged, shortest first, only as far
    as a partner must have shown up; the long lists that are left are skipped,
    and looked up for the partners that did.
    """
    codes, inverse, n = np.unique(np.concatenate([left, right]).reshape(-1), return_inverse=True, return_counts=True)
    place = np.empty(len(codes), np.int64)
    place[np.lexsort((codes, n))] = np.arange(len(codes))
    prefix = np.sort(place[inverse].reshape(-1, COORDINATES), axis=1)[:, : COORDINATES - least + 1]
    met = np.zeros((len(left), len(right)), dtype=bool)
    posted = prefix.reshape(-1)
    row = np.repeat(np.arange(len(prefix)), prefix.shape[1])
    order = np.argsort(posted, kind="stable")
    posted, row = posted[order], row[order]  # rows of a list ascend, so those of left come first
    first = np.flatnonzero(np.append(True, posted[1:] != posted[:-1])) if len(posted) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(posted))
    for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist()):
        mid = a + int(np.searchsorted(row[a:b], len(left)))
        if a < mid < b:
            met[row[a:mid, None], row[None, mid:b] - len(left)] = True
    i, j = np.nonzero(met)
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        met[x, y] = (left[x] == right[y]).sum(axis=1) >= least
    return met


def _confirmed(group: pd.DataFrame, left: np.ndarray, right: np.ndarray, percent: int, least: int, among: bool) -> pd.DataFrame:
    """Links between the rows left and right of a group: retained by their collisions, then confirmed on full sets."""
    ids, signatures = group["doc_id"].to_numpy(), np.stack(group["pairs"].to_numpy())
    kept = retained(signatures[left], signatures[right], least) & (ids[left][:, None] != ids[right][None, :])
    if among:
        kept = np.triu(kept, 1)
    left_in, right_in = np.flatnonzero(kept.any(axis=1)), np.flatnonzero(kept.any(axis=0))
    if not len(left_in):
        return _links(ids, ids, np.zeros((0, 0), bool))
    rows = np.union1d(left[left_in], right[right_in])
    with np.errstate(over="ignore"):
        sets = dict(zip(rows.tolist(), shingle_sets(pa.array(group["text"].iloc[rows]))))
    linked = _linked([sets[i] for i in left[left_in].tolist()], [sets[i] for i in right[right_in].tolist()], percent)
    return _links(ids[left[left_in]], ids[right[right_in]], linked & kept[np.ix_(left_in, right_in)])


def _small_group(percent: int, least: int):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        every = np.arange(len(group))
        return _confirmed(group, every, every, percent, least, True)

    return compare


def _block(percent: int, least: int):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        far = group["far"].to_numpy()
        return _confirmed(group, np.flatnonzero(far), np.flatnonzero(~far), percent, least, False)

    return compare


def _star(percent: int, least: int):
    """Rows of a part of a group, its hub first, to whether each is linked to the hub; the hub's set is made once a part."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_pairs = hub_set = None
        for batch in _portions(batches):
            pairs = batch.column("pairs").flatten().to_numpy().reshape(-1, COORDINATES)
            member = batch.column("member").to_numpy(zero_copy_only=False)
            linked = np.zeros(batch.num_rows, dtype=bool)
            bounds = [0, *np.flatnonzero(~member).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                if not member[a]:
                    hub_pairs, hub_set = pairs[a], _sets(batch.column("text").slice(a, 1))[0]
                near = a + np.flatnonzero(collisions(pairs[a:b], hub_pairs[None])[:, 0] >= least)
                for i, own in zip(near.tolist(), _sets(batch.column("text").take(pa.array(near)))):
                    both = len(np.intersect1d(own, hub_set, assume_unique=True))
                    linked[i] = 100 * both >= percent * (len(own) + len(hub_set) - both)
            out = pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("doc_id"), pa.array(linked)], ["hub", "doc_id", "linked"])
            yield out.filter(pa.array(member))

    return compare


def _sets(texts: pa.Array) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return shingle_sets(texts)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, pairs): the set's size, a 128-bit digest of it, and the signature's (coordinate, value) pairs as 64-bit codes."""
    return docs.select("doc_id", "text").mapInArrow(_signatures, _SIGNED)


def postings(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(pair, doc_id, weight): each text under the rarest of its pairs that a partner at percent must share.

    A pair that only one text has is passed over but counts towards the prefix,
    so a text with many of its own needs no posting at all.
    """
    one = reps.select("doc_id", F.explode("pairs").alias("pair"))
    common = one.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1")
    own = one.join(common, "pair").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "pair"))).alias("p"))
    keep = F.lit(COORDINATES - matches(percent) + 1) - (F.lit(COORDINATES) - F.size("p"))
    return own.where(keep > 0).select("doc_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("weight"), F.explode(F.slice("p", F.lit(1), keep)).alias("x")).select(F.col("x.pair").alias("pair"), "doc_id", "weight")


def hub_members(posted: DataFrame) -> DataFrame:
    """(hub, doc_id): the texts that share a list, under the list's hub, which is one of them."""
    hubs = posted.groupBy("pair").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"))).alias("h"), F.count("*").alias("n")).where("n > 1")
    return posted.join(hubs.select("pair", (-F.col("h.minus")).alias("hub")), "pair").select("hub", "doc_id").distinct()


def links(docs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between texts with different sets, enough of them to join whatever all links join."""
    members = cut(hub_members(postings(reps, percent)))
    # A merge join whatever the size: what it moves is then in proportion to the input.
    wanted = members.select("doc_id").distinct().join(reps.select("doc_id", "pairs"), "doc_id")
    texts = cut(docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id").dropDuplicates(["doc_id"]))
    sizes = members.groupBy("hub").agg(F.count("*").alias("n"))
    with_text = members.join(sizes.where(F.col("n") <= BLOCK), "hub").join(texts, "doc_id").select("hub", "doc_id", "pairs", "text")
    small = with_text.groupBy("hub").applyInPandas(_small_group(percent, matches(percent)), "a long, b long")

    large = members.join(sizes.where(F.col("n") > BLOCK), "hub")
    # A large group is cut into parts of about BLOCK members, each with one copy of the hub.
    parts = F.ceil(F.col("n") / BLOCK)
    others = large.where("hub <> doc_id").select("hub", F.pmod(F.xxhash64("doc_id"), parts).cast("long").alias("part"), "doc_id", F.lit(True).alias("member"))
    hubs = large.where("hub = doc_id").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "doc_id", F.lit(False).alias("member"))
    met = others.union(hubs).join(texts, "doc_id").repartition("hub", "part").sortWithinPartitions("hub", "part", "member", "doc_id")
    star = cut(met.select("hub", "doc_id", "member", "pairs", "text").mapInArrow(_star(percent, matches(percent)), "hub long, doc_id long, linked boolean"))
    # Two texts linked to the hub are joined already; a text that isn't meets every text of the group.
    far = star.where("not linked").groupBy("hub").agg(F.count("*").alias("n_far"))
    shape = large.select("hub", "n").distinct().join(far, "hub").select("hub", F.ceil(F.col("n") / BLOCK).alias("cols"), F.ceil(F.col("n_far") / BLOCK).alias("rows"))
    place = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("long")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = star.where("not linked").join(shape, "hub").select("hub", place(F.col("rows")).alias("i"), spread("cols").alias("j"), "doc_id", F.lit(True).alias("far"))
    cols = large.join(shape, "hub").select("hub", spread("rows").alias("i"), place(F.col("cols")).alias("j"), "doc_id", F.lit(False).alias("far"))
    blocks = rows.unionByName(cols).join(texts, "doc_id").groupBy("hub", "i", "j").applyInPandas(_block(percent, matches(percent)), "a long, b long")
    return small.union(blocks).union(star.where("linked").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    Words are runs of `[^\\x20\\x09-\\x0D]` with A-Z lower-cased; the set of a
    text is its distinct five-word shingles, or its whole word sequence when it
    is shorter. Null, empty and blank texts have the empty set, link to nothing
    and are kept. component_id is the least doc_id that links reach. Texts with
    one set are one class and joined by its digest, so copies are never paired.
    A repeated doc_id is repeated in the result; other columns are not read.
    A row without a doc_id is a document of its own, and comes after all ids: one
    of a group of such rows is kept, and its component_id is null.
    """
    keyed, most = with_keys(docs.select("doc_id", "text"))
    docs = keyed.select(F.col("_row_key").alias("doc_id"), "text")
    every = cut(signed(docs))
    classes = every.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = cut(every.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "pairs"))
    found = connected_components(cut(links(docs, reps, percent)))
    joined = classes.join(found, classes["rep"] == found["node"], "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = every.select("doc_id", "n_shingles", "set_a", "set_b").join(joined, ["set_a", "set_b", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if most is None:
        return out
    given = lambda c: F.when(F.col(c) <= most, F.col(c)).alias(c)
    return out.select(given("doc_id"), "n_shingles", given("component_id"), "kept")
