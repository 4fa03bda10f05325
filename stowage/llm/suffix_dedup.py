"""Removal of byte strings that occur twice, by merging front-coded sorted suffix runs.

Every LENGTH-byte window of a text selects one anchor in it, the leftmost of its
least GRAM-byte strings by hash, so equal windows have anchors at one offset and
only suffixes that begin at anchors need sorting. Anchors whose gram occurs once
in the corpus are left out first. Each map task sorts its suffixes, front-codes
them (length shared with the one before, then the rest) and deals the runs out
by gram; a reducer merges its runs with a loser tree that knows the prefix each
candidate shares with the last winner and compares from there on only. Equal
windows then lie in neighbouring suffixes.

Grams that occur very often don't meet in one reducer. Their contexts are
grouped by their bytes; windows of the distinct ones meet by digest, and one
counts as repeated only where its bytes are those of another.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_keys
from .textbytes import BYTE_VALUES, flat, prefix_hash, slices, span_hash

LENGTH, GRAM = 200, 32
#: The suffixes of a gram with more occurrences than this are dealt out by windows instead of merged in one reducer.
HOT = 2048
#: Bits of the digests by which such windows meet.
DIGEST_BITS = 64
#: Suffixes that one reducer merges, and bytes that a map task holds before it writes its runs.
PER_PART, RUN_BYTES = 25_000, 24 << 20

_SLICE = 1 << 19
_POSITION = np.uint64((1 << 20) - 1)


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min(keys[i:i + width]), in three passes whatever the width."""
    n = len(keys) - width + 1
    pad = -len(keys) % width
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window, gram hash) of each run of windows with one anchor.

    Positions are in data; windows never leave their text. What a window selects
    depends on its bytes alone.
    """
    out: list[tuple[np.ndarray, ...]] = []
    n = len(data)
    cross = np.zeros(n + 1, dtype=np.int32)
    np.add.at(cross, np.maximum(offsets[:-1], offsets[1:] - length + 1), 1)
    np.add.at(cross, offsets[1:], -1)
    inside = np.cumsum(cross[:-1]) == 0
    for begin in range(0, max(0, n - length + 1), _SLICE):
        part = data[begin : begin + _SLICE + length - 1]
        valid = inside[begin : begin + len(part) - length + 1]
        if not valid.any():
            continue
        at = np.arange(len(part) - gram + 1)
        grams = span_hash(prefix_hash(BYTE_VALUES[part]), at, at + gram)
        least = _sliding_least((grams & ~_POSITION) | at.astype(np.uint64), length - gram + 1)
        chosen = (least & _POSITION).astype(np.int64)
        chosen[~valid] = -1
        turn = np.flatnonzero(np.diff(chosen)) + 1
        first, last = np.concatenate([[0], turn]), np.concatenate([turn, [len(chosen)]]) - 1
        # Neighbouring texts may not share a run: a text shorter than the window lies between, or the run ends with its text.
        keep = chosen[first] >= 0
        first, last = first[keep], last[keep]
        out.append((chosen[first] + begin, first + begin, last + begin, grams[chosen[first]]))
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    anchor, first, last, gram_hash = (np.concatenate(x) for x in zip(*out))
    return np.searchsorted(offsets, first, side="right") - 1, anchor, first, last, gram_hash


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in slices(*flat(batch.column("text"))):
            with np.errstate(over="ignore"):
                text, _, _, _, gram = anchors(data, offsets)
            order = np.lexsort((gram, text))
            text, gram = text[order], gram[order]
            new = np.ones(len(gram), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
            n = np.diff(np.append(np.flatnonzero(new), len(gram)))
            rows = pa.array(text[new] + row)
            yield pa.RecordBatch.from_arrays([pa.array(gram[new].view(np.int64)), batch.column("doc_id").take(rows), batch.column("tid").take(rows), pa.array(n.astype(np.int32))], ["gram", "doc_id", "tid", "n"])


# --- front-coded runs ---------------------------------------------------------


def _varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to be common."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def encode_run(items: list[tuple[bytes, bytes, list[tuple[int, int, int]]]]) -> bytes:
    """A sorted run of (suffix, left context, places (doc_id, text digest, first window))."""
    out, before = bytearray(), b""
    for suffix, left, places in items:
        shared = _shared(before, suffix, 0)
        _varint(out, shared)
        _varint(out, len(suffix) - shared)
        out += suffix[shared:]
        _varint(out, len(left))
        out += left
        _varint(out, len(places))
        for doc_id, tid, first in places:
            out += doc_id.to_bytes(8, "big", signed=True) + tid.to_bytes(8, "big", signed=True)
            _varint(out, first)
        before = suffix
    return bytes(out)


def decode_run(run: bytes) -> Iterator[tuple[int, bytes, bytes, list[tuple[int, int, int]]]]:
    """(length shared with the suffix before, suffix, left context, places) in order."""
    at, suffix = 0, b""

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = run[at]
            at += 1
            n |= (byte & 127) << shift
            if byte < 128:
                return n
            shift += 7

    while at < len(run):
        shared = number()
        size = number()
        suffix = suffix[:shared] + run[at : at + size]
        at += size
        size = number()
        left = run[at : at + size]
        at += size
        places = []
        for _ in range(number()):
            doc_id, tid = int.from_bytes(run[at : at + 8], "big", signed=True), int.from_bytes(run[at + 8 : at + 16], "big", signed=True)
            at += 16
            places.append((doc_id, tid, number()))
        yield shared, suffix, left, places


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes, list[tuple[int, int, int]]]]:
    """The items of all runs in order, each with the length it shares with the one before.

    A loser tree: known[i] is what run i's head shares with the last winner, for
    every loser on that winner's path. The longer such prefix wins unseen; only
    equal ones compare bytes, and from that length on.
    """
    if not runs:
        return
    streams = [decode_run(r) for r in runs]
    heads: list = [next(s, None) for s in streams]
    size = 1 << (len(runs) - 1).bit_length() if len(runs) > 1 else 1
    heads += [None] * (size - len(heads))
    known = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), and the loser learns what it shares with the winner."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        u, v = x[1], y[1]
        n = _shared(u, v, known[a])
        if n == len(u) or (n < len(v) and u[n] < v[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    losers = [0] * size
    level = list(range(size))
    base = size
    while len(level) > 1:
        base //= 2
        up = []
        for k in range(0, len(level), 2):
            w, lost = play(level[k], level[k + 1])
            losers[base + k // 2] = lost
            up.append(w)
        level = up
    winner = level[0]
    shared = 0
    while heads[winner] is not None:
        _, suffix, left, places = heads[winner]
        yield shared, suffix, left, places
        nxt = next(streams[winner], None)
        heads[winner] = nxt
        known[winner] = nxt[0] if nxt else 0
        node = (winner + size) // 2
        while node >= 1:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
        shared = known[winner]


def _duplicated(group: list[list], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(doc_id, text digest, start, end) covered by windows of one gram's suffixes that occur twice.

    group: [suffix, left, places, longest prefix shared with another suffix].
    """
    if len(group) == 1 and len(group[0][2]) == 1:
        return
    seen: dict[bytes, int] = {}
    spans = []
    for suffix, left, places, near in group:
        context = left + suffix
        windows = len(context) - length + 1
        if len(places) > 1:
            spans.append((context, windows, windows))
        else:  # a window that reaches further right than any other suffix agrees occurs once
            spans.append((context, windows, min(windows, max(0, len(left) - (length - near) + 1))))
    many = len(group) > 1
    if many:
        for (_, _, places, _), (context, _, reach) in zip(group, spans):
            weight = min(2, len(places))
            for t in range(reach):
                w = context[t : t + length]
                seen[w] = seen.get(w, 0) + weight
    for (_, _, places, _), (context, windows, reach) in zip(group, spans):
        if len(places) > 1:
            runs = [(0, windows - 1 + length)]
        else:
            runs = []
            for t in range(reach):
                if seen[context[t : t + length]] > 1:
                    if runs and t <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], t + length)
                    else:
                        runs.append((t, t + length))
        for doc_id, tid, first in places:
            for a, b in runs:
                yield doc_id, tid, first + a, first + b


def _merge(table: pa.Table) -> pa.Table:
    out: list[tuple[int, int, int, int]] = []
    group: list[list] = []
    for shared, suffix, left, places in merge_runs(table.column("run").to_pylist()):
        if shared < GRAM:
            out += _duplicated(_collapse(group), LENGTH)
            group = []
        elif group:
            group[-1][3] = max(group[-1][3], shared)
        group.append([suffix, left, places, shared if shared >= GRAM else 0])
    out += _duplicated(_collapse(group), LENGTH)
    columns = list(zip(*out)) or [(), (), (), ()]
    return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "tid", "a", "b"), columns)})


def _collapse(group: list[list]) -> list[list]:
    """One entry for equal suffix and left context, with all their places."""
    by: dict[tuple[bytes, bytes], list] = {}
    for suffix, left, places, near in group:
        if (old := by.get((suffix, left))) is not None:
            old[2] = old[2] + places
            old[3] = max(old[3], near)
        else:
            by[suffix, left] = [suffix, left, places, near]
    return list(by.values())


def _digest(data: np.ndarray, first: np.ndarray, last: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (span_hash(prefix_hash(BYTE_VALUES[data]), first, last) >> np.uint64(64 - bits)).view(np.int64)


def _runs(parts: int, bits: int):
    """Sorted runs of the suffixes at surviving anchors, by part; contexts of hot ones as they are (part -1)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple[bytes, bytes], list]] = defaultdict(dict)
        size = 0

        def flush():
            parts_out, blobs = [], []
            for part, items in held.items():
                parts_out.append(part)
                blobs.append(encode_run([(s, left, p) for (s, left), p in sorted(items.items())]))
            held.clear()
            return _run_rows(parts_out, blobs, [], [])

        for batch in batches:
            hot_places: dict[tuple[int, int, int, bytes], list[int]] = {}
            for row0, data, offsets in slices(*flat(batch.column("text"))):
                with np.errstate(over="ignore"):
                    text, anchor, first, last, gram = anchors(data, offsets)
                context = _digest(data, first, last + LENGTH, bits)
                raw = data.tobytes()
                own = batch.slice(row0, len(offsets) - 1)
                ids, tids, some, hot = (own.column(c) for c in ("doc_id", "tid", "grams", "hot"))
                kind = np.zeros(len(gram), dtype=np.int8)
                bounds = np.searchsorted(text, np.arange(len(offsets)))
                for row in np.unique(text).tolist():
                    a, b = bounds[row], bounds[row + 1]
                    signed = gram[a:b].view(np.int64)
                    kind[a:b] = np.isin(signed, np.asarray(some[row].values)) + 2 * np.isin(signed, np.asarray(hot[row].values))
                ids, tids = ids.to_pylist(), tids.to_pylist()
                for i in np.flatnonzero(kind).tolist():
                    row, p, s0, s1 = int(text[i]), int(anchor[i]), int(first[i]), int(last[i])
                    place = (ids[row], tids[row], s0 - int(offsets[row]))
                    if kind[i] >= 2:
                        hot_places.setdefault((int(context[i]), *place[:2], raw[s0 : s1 + LENGTH]), []).append(place[2])
                        continue
                    held[int(gram[i] % np.uint64(parts))].setdefault((raw[p : s1 + LENGTH], raw[s0:p]), []).append(place)
                    size += s1 + LENGTH - s0 + 150
            if hot_places:
                yield _run_rows([], [], [(*k[:3], v) for k, v in hot_places.items()], [k[3] for k in hot_places])
            if size > RUN_BYTES:
                size = 0
                yield flush()
        yield flush()

    return write


_RUN_SCHEMA = "part int, run binary, context long, doc_id long, tid long, first array<long>"


def _run_rows(parts: list, blobs: list, hot_rows: list, hot_blobs: list) -> pa.RecordBatch:
    n, m = len(parts), len(hot_rows)
    more = list(zip(*hot_rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(parts + [-1] * m, pa.int32()), pa.array(blobs + hot_blobs, pa.binary()), *(pa.array([None] * n + list(x), k) for x, k in zip(more, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))))],
        ["part", "run", "context", "doc_id", "tid", "first"],
    )


def _by_part(part: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row for each part, with the values of its entries as lists."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(first, len(part)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), *(pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns)], ["part", *names])


def _windows(parts: int, bits: int):
    """Windows of distinct contexts by part of their digest: digest, a context and offset that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row0, data, offsets in slices(*flat(batch.column("bytes"))):
                own = batch.slice(row0, len(offsets) - 1)
                counts = np.diff(offsets) - LENGTH + 1
                row = np.repeat(np.arange(len(counts)), counts)
                t = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = offsets[row] + t
                digest = _digest(data, at, at + LENGTH, bits)
                yield _by_part(digest % parts, [digest, own.column("id").to_numpy(zero_copy_only=False)[row], t], ["window", "context", "t"])

    return run


def _values(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


_CLAIM = "part int, context array<long>, t array<long>, like array<long>, like_t array<long>"


def _claimed(parts: int):
    """Of the windows of one part: each whose digest others have too, with the first of these, by part of its context."""

    def run(table: pa.Table) -> pa.Table:
        window, context, t = (_values(table, c) for c in ("window", "context", "t"))
        order = np.lexsort((t, context, window))
        window, context, t = window[order], context[order], t[order]
        first = np.flatnonzero(np.append(True, window[1:] != window[:-1])) if len(window) else np.zeros(0, np.int64)
        of = np.repeat(first, np.diff(np.append(first, len(window))))
        later = np.flatnonzero(of != np.arange(len(window)))
        return pa.Table.from_batches([_by_part(context[later] % parts, [context[later], t[later], context[of[later]], t[of[later]]], ["context", "t", "like", "like_t"])])

    return run


def _claim_runs(table: pa.Table) -> pa.Table:
    """(context, t, like, like_t, n): claims of a context's neighbouring windows about neighbouring windows, as one."""
    context, t, like, like_t = (_values(table, c) for c in ("context", "t", "like", "like_t"))
    order = np.lexsort((t, context))
    context, t, like, like_t = context[order], t[order], like[order], like_t[order]
    joins = (context[1:] == context[:-1]) & (like[1:] == like[:-1]) & (t[1:] == t[:-1] + 1) & (like_t[1:] == like_t[:-1] + 1)
    first = np.flatnonzero(np.append(True, ~joins)) if len(t) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(t)))
    return pa.table({k: pa.array(v.astype(np.int64)) for k, v in zip(("context", "t", "like", "like_t", "n"), (context[first], t[first], like[first], like_t[first], n))})


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, n, bytes): runs of windows whose bytes are those of another; where they aren't, single windows with their bytes, for those to meet by them."""
    told: set[tuple[int, int, int]] = set()
    for batch in batches:
        rows: list[tuple[int, int, int, bytes | None]] = []

        def repeated(context: int, t: int, like: int, like_t: int, n: int) -> None:
            rows.append((context, t, n, None))
            if (like, like_t, n) not in told:  # many contexts are like one
                told.add((like, like_t, n))
                rows.append((like, like_t, n, None))

        for context, t, like, like_t, n, own, other in zip(*(batch.column(c).to_pylist() for c in ("context", "t", "like", "like_t", "n", "bytes", "like_bytes"))):
            if own[t : t + n - 1 + LENGTH] == other[like_t : like_t + n - 1 + LENGTH]:
                repeated(context, t, like, like_t, n)
                continue
            for k in range(n):
                if own[t + k : t + k + LENGTH] == other[like_t + k : like_t + k + LENGTH]:
                    repeated(context, t + k, like, like_t + k, 1)
                else:
                    rows.append((context, t + k, 1, own[t + k : t + k + LENGTH]))
        if len(told) > 100_000:
            told.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["id", "t", "n", "bytes"])


def _hot_spans(hot: DataFrame) -> DataFrame:
    """(doc_id, tid, spans) for grams with many occurrences: whole contexts that repeat, and repeated windows of those that don't.

    Contexts are one where their bytes are. Windows of distinct contexts that
    share a digest claim to be like the first of them; claims of neighbouring
    windows are one, and are confirmed on the bytes of both contexts. A window
    that isn't like the first meets others like itself by its bytes.
    """
    grouped = hot.groupBy("context", F.col("run").alias("bytes")).agg(F.sum(F.size("first")).alias("n"))
    contexts = cut(grouped.withColumn("id", F.monotonically_increasing_id()))
    parts = int(max(8, -(-contexts.count() // PER_PART * 4)))
    windows = contexts.select("id", "bytes").mapInArrow(_windows(parts, DIGEST_BITS), "part int, window array<long>, context array<long>, t array<long>")
    claims = windows.groupBy("part").applyInArrow(_claimed(parts), _CLAIM)
    runs = claims.groupBy("part").applyInArrow(_claim_runs, "context long, t long, like long, like_t long, n long")
    own = contexts.select(F.col("id").alias("context"), "bytes")
    other = contexts.select(F.col("id").alias("like"), F.col("bytes").alias("like_bytes"))
    judged = cut(runs.join(own, "context").join(other, "like").mapInArrow(_confirmed, "id long, t long, n long, bytes binary"))
    alone = judged.where("bytes IS NOT NULL").distinct()
    met = alone.join(alone.groupBy("bytes").agg(F.count("*").alias("many")).where("many > 1").select("bytes"), "bytes").select("id", "t", "n")
    every = F.octet_length("bytes").cast("long") - LENGTH + 1
    whole = contexts.where("n > 1").select("id", F.lit(0).cast("long").alias("t"), every.alias("n"))
    repeated = judged.where("bytes IS NULL").select("id", "t", "n").union(met).union(whole)
    spans = F.collect_set(F.struct(F.col("t").alias("a"), (F.col("t") + F.col("n") - 1 + LENGTH).alias("b"))).alias("runs")
    found = contexts.join(repeated.groupBy("id").agg(spans), "id").select(F.col("context").alias("_context"), F.col("bytes").alias("_bytes"), "runs")
    moved = F.flatten(F.transform("first", lambda f: F.transform("runs", lambda r: F.struct((r["a"] + f).alias("a"), (r["b"] + f).alias("b")))))
    return hot.join(found, (F.col("context") == F.col("_context")) & (F.col("run") == F.col("_bytes"))).select("doc_id", "tid", moved.alias("spans"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        spans = batch.column("spans")
        removed, count, digests = [], [], []
        for i in range(batch.num_rows):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            digest, at, gone, runs = hashlib.sha256(), 0, 0, 0
            end = -1
            for s in sorted(spans[i].as_py() or [], key=lambda s: (s["a"], s["b"])):
                if s["a"] > end:
                    runs += 1
                    digest.update(raw[at : s["a"]])
                    gone += s["b"] - s["a"]
                    end = at = s["b"]
                elif s["b"] > end:
                    gone += s["b"] - end
                    end = at = s["b"]
            digest.update(raw[at:])
            removed.append(gone)
            count.append(runs)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, spans): for each text with a LENGTH-byte string that also starts elsewhere, the byte ranges [a, b) that such strings cover."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tid"))
    one = cut(keyed.mapInArrow(_grams, "gram long, doc_id long, tid long, n int"))
    common = one.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram", (F.col("n") > HOT).alias("is_hot"))
    found = cut(one.join(common, "gram").groupBy("doc_id", "tid").agg(F.collect_set(F.expr("CASE WHEN NOT is_hot THEN gram END")).alias("grams"), F.collect_set(F.expr("CASE WHEN is_hot THEN gram END")).alias("hot")))
    total = found.agg(F.sum(F.size("grams"))).first()[0] or 0
    parts = int(max(8, -(-total // PER_PART)))
    runs = cut(keyed.join(found, ["doc_id", "tid"]).mapInArrow(_runs(parts, DIGEST_BITS), _RUN_SCHEMA))
    spans = runs.where("part >= 0").select("part", "run").repartition(parts, "part").groupBy("part").applyInArrow(_merge, "doc_id long, tid long, a long, b long")
    spans = spans.select("doc_id", "tid", F.array(F.struct("a", "b")).alias("spans")).union(_hot_spans(runs.where("part < 0")))
    return spans.groupBy("doc_id", "tid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs (doc_id, text).

    Texts are UTF-8 bytes, null is empty. A byte goes if a 200-byte string that
    covers it also starts anywhere else, in another text or the same one,
    overlaps included; strings are judged on the input. n_spans counts maximal
    removed runs. Texts under 200 bytes lose nothing, so an empty table gives an
    empty result. Equal rows count as two texts, so each goes whole, and so do
    rows without a doc_id.
    """
    every, most = with_keys(docs.select("doc_id", "text"))
    docs = every.select(F.col("_row_key").alias("doc_id"), "text")
    spans = repeated_spans(docs)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tid"))
    out = keyed.join(spans, ["doc_id", "tid"], "left").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out if most is None else out.withColumn("doc_id", F.when(F.col("doc_id") <= most, F.col("doc_id")))
