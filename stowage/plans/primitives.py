"""Shared primitives: global order without a single-partition window, greedy bins by range, Merkle trees by aligned subtrees."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-stowage-"))
    return _local[0]


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, without lineage."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_rows(batches: Iterator[pa.RecordBatch], n: int = 64) -> Iterator[pa.RecordBatch]:
    """batches in parts of n rows, so that of rows with bytes few are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def global_prefix(df: DataFrame, order: list, value: Column | None = None) -> DataFrame:
    """df with idx (0-based place in the total order) and, given value, before (sum of value over earlier rows).

    Rows are dealt by range of the order, totals are made per range, and the
    small table of totals is summed up; no task orders the whole input.
    """
    value = F.lit(0) if value is None else value
    placed = cut(df.withColumn("_v", value.cast("long")).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    totals = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = totals.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    inside = Window.partitionBy("_p").orderBy(*order)
    sums = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumn("_r", F.row_number().over(inside)).withColumn("_c", F.sum("_v").over(sums)).join(F.broadcast(offsets), "_p")
    return out.withColumn("idx", (F.col("_n0") + F.col("_r") - 1).cast("long")).withColumn("before", (F.col("_s0") + F.col("_c") - F.col("_v")).cast("long")).drop("_p", "_v", "_n0", "_s0", "_r", "_c")


def sums_within(df: DataFrame, keys: list[str], order: list, value: Column, before: str) -> DataFrame:
    """df with before, the sum of value over its keys' earlier rows in order: as global_prefix, so a key with most of the rows is many tasks.

    Only the first key of a range can have rows in an earlier one, so what
    ranges tell each other is one row for each range.
    """
    placed = cut(df.withColumn("_v", value.cast("long")).repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    key = F.struct(*keys)
    ends = placed.groupBy("_p").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))  # one row for each partition, as all tables below
    counts = placed.join(F.broadcast(ends), "_p").where(key.eqNullSafe(F.col("_lo")) | key.eqNullSafe(F.col("_hi"))).groupBy("_p", key.alias("_k")).agg(F.sum("_v").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("_p").alias("_q"), "_k", earlier.alias("_n0")).where("_n0 <> 0")
    inside = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("_r", F.sum("_v").over(inside) - F.col("_v"))
    same = (F.col("_p") == F.col("_q")) & key.eqNullSafe(F.col("_k"))
    return ranked.join(F.broadcast(offsets), same, "left").select(*df.columns, (F.coalesce("_n0", F.lit(0)) + F.col("_r")).cast("long").alias(before))


def places_within(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df with place, 0-based within its keys' rows in order."""
    return sums_within(df, keys, order, F.lit(1), "place")


def _entries(cap: int):
    """Rows as they come, and after them what their range does to whatever is open when it begins: (from, to] of used to what is used at the end and how many bins closed, as pieces of a function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, ranges = [], 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sizes.append(batch.column("_size").to_numpy(zero_copy_only=False))
            ranges = batch.column("_range")[0].as_py()
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, none, none, none, none], [*batch.schema.names, "_from", "_to", "_exit", "_closed"])
        if not sizes:
            return
        size = np.concatenate(sizes)
        ends = np.cumsum(size)
        n, total = len(size), int(ends[-1])
        hop = np.searchsorted(ends, ends - size + cap, "right").tolist()  # the row that closes a bin that begins here
        left, closed = [0] * (n + 1), [0] * (n + 1)
        for j in range(n - 1, -1, -1):
            k = hop[j]
            left[j], closed[j] = (left[k], closed[k] + 1) if k < n else (total - int(ends[j]) + int(size[j]), 0)
        pieces = []
        if cap >= total:
            pieces.append((-1, cap - total, total, 0))  # nothing closes: what is used grows by all
        high = cap
        for j in range(n):
            low = max(-1, cap - int(ends[j]))
            if low < high:
                piece = (low, high, left[j], closed[j] + 1)
                if len(pieces) > 1 and pieces[-1][0] == high and pieces[-1][2:] == piece[2:]:
                    pieces[-1] = (low, *pieces[-1][1:])
                else:
                    pieces.append(piece)
                high = low
            if low < 0:
                break
        schema = batch.schema
        columns = [pa.nulls(len(pieces), f.type) for f in schema]
        columns[schema.get_field_index("_range")] = pa.array([ranges] * len(pieces), pa.int64())
        lists = [pa.array(c, pa.int64()) for c in zip(*pieces)]
        yield pa.RecordBatch.from_arrays([*columns, *lists], [*schema.names, "_from", "_to", "_exit", "_closed"])

    return run


def _walk(cap: int):
    """(range, used, closed) at the beginning of each range, from the pieces of all ranges in order; nothing but the current range is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, closed, after = None, 0, 0, (0, 0)
        for batch in batches:
            out = []
            for r, low, high, left, n in zip(*(batch.column(c).to_pylist() for c in ("_range", "_from", "_to", "_exit", "_closed"))):
                if r != at:
                    at, (used, closed) = r, after
                    out.append((r, used, closed))
                if low < used <= high:
                    after = (left if n else used + left, closed + n)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], ["_range", "_used", "_before"])

    return run


def _numbered(cap: int):
    """Rows of each range in order with their bin, from what was used and closed before the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, number = None, 0, 0
        for batch in batches:
            bins = []
            for r, size, start, before in zip(*(batch.column(c).to_pylist() for c in ("_range", "_size", "_used", "_before"))):
                if r != at:
                    at, used, number = r, start, before
                if used + size > cap:
                    used, number = 0, number + 1
                used += size
                bins.append(number)
            keep = [i for i, name in enumerate(batch.schema.names) if not name.startswith("_")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(bins, pa.int64())], [*(batch.schema.names[i] for i in keep), "bin"])

    return run


def next_fit(df: DataFrame, order: list, size: Column, cap: int) -> DataFrame:
    """df, whose sizes aren't above cap, with bin: order-preserving bins, each closed when the next row would exceed cap.

    Two passes, whatever the number of bins. Rows are dealt by ranges of the
    order; each range says, for all that may be used in the bin that is open
    when it begins, what is used at its end and how many bins it closes. Such a
    function has at most as many pieces as rows fit into one bin, and fewer as
    chains of bins run together. One task walks through the pieces of all ranges;
    then each range numbers its own rows.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    dealt = df.withColumn("_size", size.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_range", F.spark_partition_id().cast("long")).withColumn("_place", F.monotonically_increasing_id())
    inner = f"{schema}, _size long, _range long, _place long"
    rows = cut(dealt.mapInArrow(_entries(cap), f"{inner}, _from long, _to long, _exit long, _closed long"))
    pieces = rows.where("_to IS NOT NULL").select("_range", "_from", "_to", "_exit", "_closed")
    starts = cut(pieces.coalesce(1).sortWithinPartitions("_range", "_to").mapInArrow(_walk(cap), "_range long, _used long, _before long"))
    each = rows.where("_place IS NOT NULL").drop("_from", "_to", "_exit", "_closed").join(F.broadcast(starts), "_range")  # one row for each range
    return each.repartition("_range").sortWithinPartitions("_range", "_place").select(*df.columns, "_range", "_size", "_used", "_before").mapInArrow(_numbered(cap), f"{schema}, bin long")


def combine(left: bytes, right: bytes) -> bytes:
    """The parent of two 32-byte nodes: sha256 of both, the top two bits of the last byte cleared."""
    h = bytearray(hashlib.sha256(left + right).digest())
    h[31] &= 63
    return bytes(h)


def zero_nodes(levels: int) -> list[bytes]:
    """Roots of all-zero trees of 32 * 2^k bytes."""
    out = [bytes(32)]
    for _ in range(levels):
        out.append(combine(out[-1], out[-1]))
    return out


class Fold:
    """Nodes of one tree in order of their place, folded as far as they and the zeros between them allow.

    from_start tells that no earlier node exists. Where it isn't known, a right
    child whose sibling would lie before the first node waits.
    """

    def __init__(self, zeros: list[bytes], from_start: bool):
        self.zeros, self.from_start, self.first = zeros, from_start, None
        self.stack: list[tuple[int, int, bytes]] = []  # height, place in its level, node

    def push(self, height: int, pos: int, node: bytes) -> None:
        start = pos << height
        if self.first is None:
            self.first = 0 if self.from_start else start
        self.settle(start)
        self.stack.append((height, pos, node))
        self.pair()

    def pair(self) -> None:
        """Folds the last node with its left sibling as long as that is there, or is all zeros."""
        while self.stack:
            height, pos, node = self.stack[-1]
            if not pos & 1:
                return
            if len(self.stack) > 1 and self.stack[-2][:2] == (height, pos - 1):
                self.stack[-2:] = [(height + 1, pos >> 1, combine(self.stack[-2][2], node))]
                continue
            before = (self.stack[-2][1] + 1) << self.stack[-2][0] if len(self.stack) > 1 else self.first
            if (pos - 1) << height < before:
                return
            self.stack[-1] = (height + 1, pos >> 1, combine(self.zeros[height], node))

    def settle(self, start: int) -> None:
        """Nothing lies between the last node and start: right siblings that end there are all zeros."""
        while self.stack:
            height, pos, node = self.stack[-1]
            if pos & 1 or (pos + 2) << height > start:
                return
            self.stack[-1] = (height + 1, pos >> 1, combine(node, self.zeros[height]))
            self.pair()

    def root(self, top: int) -> bytes:
        """The root at height top, with zeros where no node is."""
        self.settle(1 << top)
        while self.stack[-1][0] < top:
            height, pos, node = self.stack[-1]
            self.stack[-1] = (height + 1, pos >> 1, combine(self.zeros[height], node) if pos & 1 else combine(node, self.zeros[height]))
            self.pair()
        return self.stack[-1][2]


def _folded(keys: list[str], final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros = zero_nodes(64)
        kinds = None
        names = [*keys, "node"] if final else [*keys, "height", "pos", "node", "top"]
        at, fold, high = None, None, 0

        def done() -> list[tuple]:
            if at is None:
                return []
            return [(*at, fold.root(high))] if final else [(*at, *x, high) for x in fold.stack]

        for batch in batches:
            kinds = {f.name: f.type for f in batch.schema}
            out = []
            for *key, height, pos, node, top in zip(*(batch.column(c).to_pylist() for c in [*keys, "height", "pos", "node", "top"])):
                if tuple(key) != at:
                    out += done()
                    at, fold = tuple(key), Fold(zeros, final)
                high = top
                fold.push(height, pos, node)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*out) if out else [[]] * len(names), names)], names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*done()), names)], names)

    return run


def merkle_roots(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, root) of rows (keys, height, pos, node, top): nodes of 2^height leaves at place pos of their level, up to height top; what no node covers is zeros.

    Two shuffles, whatever the height. Nodes are dealt by ranges of key and
    place, so a large tree is many tasks; each folds the aligned subtrees that
    lie in its range. At most two nodes a level are left of each range and key,
    and of these the root is made in a second pass. Nodes are 32 bytes.
    """
    kinds = dict(nodes.dtypes)
    start = F.expr("shiftleft(pos, height)")
    rows = nodes.select(*keys, F.col("height").cast("int").alias("height"), F.col("pos").cast("long").alias("pos"), "node", F.col("top").cast("int").alias("top"))
    key_schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    dealt = rows.withColumn("_start", start).repartitionByRange(*keys, "_start").sortWithinPartitions(*keys, "_start").drop("_start")
    parts = dealt.mapInArrow(_folded(keys, False), f"{key_schema}, height int, pos long, node binary, top int")
    again = parts.withColumn("_start", start).repartition(*keys).sortWithinPartitions(*keys, "_start").drop("_start")
    return again.mapInArrow(_folded(keys, True), f"{key_schema}, node binary").withColumnRenamed("node", "root")


def merkle_sql(nodes: str, key: str, levels: int, name: str = "") -> str:
    """CTEs in SQL that make roots (key, root in hex) of a CTE (key, height, pos, node in hex, top), a level at a time: the same by another way. name tells several apart."""
    zeros = [z.hex() for z in zero_nodes(levels)]
    steps = [f"{name}l0 AS MATERIALIZED (SELECT {key}, pos, node, top FROM {nodes} WHERE height = 0)"]
    for k in range(levels):
        pair = f"coalesce(max(node) FILTER (pos % 2 = 0), '{zeros[k]}') || coalesce(max(node) FILTER (pos % 2 = 1), '{zeros[k]}')"
        last = "h[1:62] || printf('%02x', ('0x' || h[63:64])::BIGINT & 63)"
        steps.append(f"""{name}l{k + 1} AS MATERIALIZED (SELECT {key}, pos, node, top FROM {name}l{k} WHERE top <= {k} UNION ALL SELECT {key}, pos, {last}, top FROM (SELECT {key}, pos // 2 AS pos, sha256(unhex({pair})) AS h, any_value(top) AS top FROM {name}l{k} WHERE top > {k} GROUP BY {key}, pos // 2)
    UNION ALL SELECT {key}, pos, node, top FROM {nodes} WHERE height = {k + 1})""")
    return ", ".join(steps) + f", {name}roots AS (SELECT {key}, node AS root FROM {name}l{levels})"
