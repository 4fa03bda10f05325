"""Vector codes by product quantisation, with adaptive distance bounds from round to round (Drake and Hamerly, 2012).

Each part of each vector keeps its assigned entry, the b entries closest to it
after that with ordered lower bounds of their distances, and one outer bound
for all other entries. A round first moves the bounds by what the entries
moved; only parts whose upper bound reaches a lower one are verified with
integer distances, against as many of the kept entries as the bounds leave
open, or against the whole codebook where the outer bound is reached too.
Bounds are integers, lower ones rounded down and upper ones up, so an entry is
certain only where it is strictly nearest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components are held within this, which keeps a vector's error within 63 bits.
MOST = 1 << 27
#: The bound where no entry is left.
NONE_LEFT = 1 << 60
#: Kept entries beside the assigned one, at first; they get fewer, never fewer than LEAST.
FIRST, LEAST = ENTRIES // 4, 1
#: Labels that are broadcast with their sums; more are joined with this many salts.
BROADCAST_LABELS, SALTS = 20_000, 64

_STATE = "vec_id long, label int, parts array<int>, near array<byte>, low array<long>, up array<long>, asked array<byte>"


def usable(column: Column) -> Column:
    """Not null and without null or non-finite components."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & ~bad


def integer_parts(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, parts) of the usable rows: components as floor(SCALE * x), with zeros up to the longest vector's length, rounded up to whole parts."""
    rows = embeddings.where(usable(F.col("embedding"))).select("vec_id", F.col("label").cast("int").alias("label"), "embedding")
    longest = rows.agg(F.max(F.size("embedding"))).first()[0] or PARTS
    width = max(1, math.ceil(longest / PARTS)) * PARTS
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return rows.select("vec_id", "label", F.when(F.size(whole) == width, whole).otherwise(F.concat(whole, F.array_repeat(F.lit(0), F.lit(width) - F.size(whole)))).alias("parts"))


def _flat(column: pa.Array, width: int, kind) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))


def _distances(x: np.ndarray, books: np.ndarray, part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of x (rows, d) from the entries (rows, m) of the books (parts, entries, d) of each row's part."""
    gap = books[part[:, None], entries] - x[:, None, :]
    return np.einsum("rmd,rmd->rm", gap, gap)


def _floor_root(squares: np.ndarray) -> np.ndarray:
    root = np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def _ceil_root(squares: np.ndarray) -> np.ndarray:
    root = _floor_root(squares)
    return root + (root * root < squares)


class Bounds:
    """What a batch's parts (one row each) keep: near (assigned entry, then the closest), low (their lower bounds, the last for all others), up."""

    def __init__(self, x: np.ndarray, part: np.ndarray, near: np.ndarray, low: np.ndarray, up: np.ndarray):
        self.x, self.part, self.near, self.low, self.up = x, part, near, low, up
        self.asked = np.zeros(len(x), np.int64)

    @classmethod
    def unknown(cls, x: np.ndarray, part: np.ndarray, entries: int, b: int) -> Bounds:
        """Nothing is known: every part is verified against the whole codebook."""
        b = max(0, min(b, entries - 1))
        return cls(x, part, np.zeros((len(x), b + 1), np.int64), np.full((len(x), b + 1), -1), np.zeros(len(x), np.int64))

    def narrow(self, b: int) -> None:
        """b closest entries from now on; the bound of the first one given up holds for all others, as bounds are ordered."""
        self.near, self.low = self.near[:, : b + 1], self.low[:, : b + 1]

    def move(self, moved: np.ndarray) -> None:
        """Entries moved by at most moved (parts, entries): bounds give way by that and stay ordered."""
        self.up = self.up + moved[self.part, self.near[:, 0]]
        self.low[:, :-1] -= moved[self.part[:, None], self.near[:, 1:]]
        self.low[:, -1] -= moved.max(axis=1)[self.part]
        self._order()

    def _order(self) -> None:
        self.low = np.minimum.accumulate(self.low[:, ::-1], axis=1)[:, ::-1].copy()

    def assign(self, books: np.ndarray) -> None:
        """The nearest entry of each part, ties to the lower index; asked gets how many entries it was compared with."""
        open_ = np.flatnonzero(self.up >= self.low[:, 0])
        if not len(open_):
            return
        own = _distances(self.x[open_], books, self.part[open_], self.near[open_, :1])[:, 0]
        self.up[open_] = _ceil_root(own)
        self.asked[open_] = 1
        reach = (self.low[open_] <= self.up[open_, None]).sum(axis=1)
        widest = self.low.shape[1]
        for j in np.unique(reach[reach > 0]):
            rows = open_[reach == j]
            if j < widest:
                entries = self.near[rows, : j + 1]
            else:
                entries = np.broadcast_to(np.arange(books.shape[1]), (len(rows), books.shape[1]))
            self.asked[rows] = entries.shape[1]
            squares = _distances(self.x[rows], books, self.part[rows], entries)
            order = np.lexsort((entries, squares), axis=1)
            entries, squares = np.take_along_axis(entries, order, 1), np.take_along_axis(squares, order, 1)
            self.up[rows] = _ceil_root(squares[:, 0])
            if j < widest:
                self.near[rows, : j + 1] = entries
                self.low[rows, :j] = _floor_root(squares[:, 1:])
            else:
                self.near[rows] = entries[:, :widest]
                after = squares[:, 1 : widest + 1]
                self.low[rows, : after.shape[1]] = _floor_root(after)
                self.low[rows, after.shape[1] :] = NONE_LEFT
        self._order()


def _round(books: list | None, moved: list | None, b: int, entries: int):
    """Rows of the state with bounds moved and parts assigned again; at first (no moved) from nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = np.array(books, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = batch.column("parts").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(n * PARTS, -1).astype(np.int64)
            part = np.tile(np.arange(PARTS), n)
            if moved is None:
                state = Bounds.unknown(x, part, entries, b)
            else:
                width = len(batch.column("near").flatten()) // (n * PARTS)
                state = Bounds(x, part, _flat(batch.column("near"), width, np.int64), _flat(batch.column("low"), width, np.int64), batch.column("up").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                state.narrow(b)
                state.move(np.array(moved, np.int64))
            state.assign(book)
            per_row = lambda a: a.reshape(n, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("parts"), _lists(per_row(state.near), pa.int8()), _lists(per_row(state.low), pa.int64()), _lists(per_row(state.up), pa.int64()), _lists(per_row(state.asked), pa.int8())],
                ["vec_id", "label", "parts", "near", "low", "up", "asked"],
            )

    return run


def _sums(entries: int):
    """(part, entry, n, sums, asked, parts): what a batch adds to each entry, and how many parts asked for so many distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("parts").flatten().to_numpy(zero_copy_only=False).reshape(n * PARTS, -1).astype(np.int64)
            near = batch.column("near").flatten().to_numpy(zero_copy_only=False).reshape(n * PARTS, -1)[:, 0]
            key = np.tile(np.arange(PARTS), n) * entries + near
            order = np.argsort(key, kind="stable")
            keys, first, counts = np.unique(key[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(x[order], first, axis=0)
            asked, many = np.unique(batch.column("asked").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            rows = [(int(k) // entries, int(k) % entries, int(c), s.tolist()) for k, c, s in zip(keys, counts, sums)] + [(-1, int(a), int(m), None) for a, m in zip(asked, many)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["part", "entry", "n", "sums"])

    return run


def _narrowed(asked: dict[int, int], b: int) -> int:
    """How many closest entries to keep: with the bounds' cost (one step for each kept one) against that of the distances each width would have asked for."""
    total = sum(asked.values())

    def cost(width: int) -> float:
        return (width + 1) * total + sum(n * (a if a <= width + 1 else ENTRIES) for a, n in asked.items()) * 2

    return min(range(min(LEAST, b), b + 1), key=cost)


def fit_codes(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """(vec_id, label, parts, near) of every usable row after the last assignment, and the codebooks (part, entry, component).

    The codebooks begin as the parts of the ENTRIES usable rows that are first
    by vec_id (ties by label and components, null ids last). What reaches the driver in a
    round are PARTS * ENTRIES sums.
    """
    start = cut(integer_parts(embeddings))
    first = start.orderBy(F.asc_nulls_last("vec_id"), "label", "parts").limit(ENTRIES).collect()
    if not first:
        return start.withColumn("near", F.array().cast("array<tinyint>")), [[] for _ in range(PARTS)]
    width = len(first[0]["parts"]) // PARTS
    books = [[list(r["parts"][p * width : (p + 1) * width]) for r in first] for p in range(PARTS)]
    entries, b, moved, state = len(first), min(FIRST, len(first) - 1), None, start
    for done in range(rounds + 1):
        before, state = state, cut(state.mapInArrow(_round(books, moved, b, entries), _STATE))
        drop(before)
        if done == rounds:
            break
        found = state.select("parts", "near", "asked").mapInArrow(_sums(entries), "part int, entry int, n long, sums array<long>")
        each = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width)]).alias("sums")).collect()
        new = [[list(e) for e in book] for book in books]
        for r in each:
            if r["part"] >= 0:
                new[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
        moved = [[math.isqrt(sum((a - c) ** 2 for a, c in zip(e, f)) - 1) + 1 if e != f else 0 for e, f in zip(old, now)] for old, now in zip(books, new)]
        books = new
        if done:  # the first assignment asks for every distance
            b = _narrowed({r["entry"]: r["n"] for r in each if r["part"] < 0}, b)
    return state, books


def _coded(books: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = np.array(books, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("parts").flatten().to_numpy(zero_copy_only=False).reshape(n * PARTS, -1).astype(np.int64)
            near = batch.column("near").flatten().to_numpy(zero_copy_only=False).reshape(n * PARTS, -1)[:, :1].astype(np.int64)
            error = _distances(x, book, np.tile(np.arange(PARTS), n), near).reshape(n, PARTS).sum(axis=1)
            code = [bytes(c).hex() for c in near.reshape(n, PARTS).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every row of embeddings (vec_id, embedding, label) with a usable vector.

    Rows whose vector is null or has a null or non-finite component are left
    out. A shorter vector counts as if zeros followed, up to the longest one's
    length, and that up to a multiple of PARTS; components beyond
    MOST / SCALE count as that. With fewer than ENTRIES usable rows there are as
    many entries. Repeated rows are coded each and count each; null ids and
    labels stay, null labels together. An empty table gives an empty result;
    other columns aren't read.
    """
    state, books = fit_codes(embeddings)
    text = ",".join(str(v) for book in books for entry in book for v in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    if not books[0]:
        return state.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
    coded = cut(state.select("vec_id", "label", "parts", "near").mapInArrow(_coded(books), "vec_id long, label int, code string, error long"))
    drop(state)
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    if labels.count() <= BROADCAST_LABELS:
        joined = coded.alias("c").join(F.broadcast(labels).alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    else:
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        spread = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.alias("c").join(spread.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")) & (F.col("c.salt") == F.col("l.salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
