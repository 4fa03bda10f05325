"""Interleaving sources by Pfair scheduling.

Documents of a source are dealt, in hashed order, into blocks. Block k of a
source with target share w may start once k / w of the mix is out and must be
out by (k + 1) / w; where a source has run out, the others share its part. Of
the blocks that may start, the one with the earliest deadline goes next, which
keeps every source within one block of its share at every point of the mix.

Sources that don't fill a block can't be a block off, so they are scheduled
together, as one source with the sum of their shares. The schedule then has a
bounded number of sources and blocks however many sources there are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut

#: Blocks in the whole mix at most: blocks grow with the corpus, the schedule doesn't.
MAX_BLOCKS = 4096
#: Documents in a block at least.
MIN_BLOCK = 16
#: Default target shares are document counts to this power, normalised.
TEMPER = 0.7
#: Documents of one range of the hash by which a source's documents are ranked, so that a large source is many tasks; ranges at least.
PER_RANGE, RANGES = 50_000, 1024
#: The name under which sources below one block are scheduled; it can't be that of a source, as null stands for it.
POOL = None
_EPS = 1e-7


def ranked(docs: DataFrame, lane: str = "lane", total: int = 0) -> DataFrame:
    """docs with rank: a 0-based place of each document in its lane, in order of a hash; null is a lane too.

    Counts per lane and hash range are added up, then ranks are made within a
    range; ranges grow with the total, so a lane of any share is ranked by many
    tasks.
    """
    bits = max(RANGES, total // PER_RANGE).bit_length()
    keyed = docs.withColumn("h", F.xxhash64("doc_id", F.lit(9))).withColumn("range", F.shiftrightunsigned("h", 64 - bits))
    counts = keyed.groupBy(lane, "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(lane).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(lane).alias("l"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy(lane, "range").orderBy("h", "doc_id")
    joined = keyed.withColumn("i", F.row_number().over(inside)).join(offsets, F.col(lane).eqNullSafe(F.col("l")) & (F.col("range") == F.col("r")))
    return joined.select(*docs.columns, (F.col("n0") + F.col("i") - 1).alias("rank"))


def block_size(total: int, max_blocks: int = MAX_BLOCKS, min_block: int = MIN_BLOCK) -> int:
    """Documents of a block, in a mix of total."""
    return max(min_block, 1, -(-total // max_blocks))


def lanes(shares: DataFrame, size: int) -> DataFrame:
    """(source, n, share, docs) with the sources of fewer than size documents as one source POOL."""
    lane = F.when(F.col("n") >= size, F.col("source")).otherwise(F.lit(POOL))
    return shares.groupBy(lane.alias("source")).agg(F.sum("n").alias("n"), F.sum("share").alias("share"), F.max("docs").alias("docs"))


def source_shares(docs: DataFrame, source: str = "source", targets: dict[str, float] | None = None, temper: float = TEMPER) -> DataFrame:
    """(source, n, share): documents of each source and its target share; sources that targets doesn't name get the least share named there."""
    counts = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if targets:
        named = F.create_map(*[x for k, v in sorted(targets.items()) for x in (F.lit(k), F.lit(float(v)))])
        weight: Column = F.coalesce(named[F.col("source")], F.lit(min(map(float, targets.values()))))
    else:
        weight = F.pow(F.col("n"), F.lit(temper))
    weighed = counts.withColumn("w", weight)
    total = weighed.agg(F.sum("w").alias("all"), F.sum("n").alias("docs"))
    return weighed.join(F.broadcast(total)).select("source", "n", (F.col("w") / F.col("all")).alias("share"), "docs")


def schedule(shares: DataFrame, max_blocks: int = MAX_BLOCKS, min_block: int = MIN_BLOCK) -> DataFrame:
    """(source, block, slot, block_size): the slot of every block of every source.

    At most max_blocks full blocks and one part-filled block for each source; of
    lanes() these are at most max_blocks + 1 sources, so the schedule is one row
    of bounded size, folded slot by slot.
    """
    sized = shares.withColumn("block_size", F.greatest(F.lit(min_block), F.lit(1), F.ceil(F.col("docs") / max_blocks)).cast("long")).withColumn("blocks", F.ceil(F.col("n") / F.col("block_size")).cast("int"))
    sources = F.array_sort(F.collect_list(F.struct("source", "blocks", "share", (F.col("blocks") / F.col("share")).alias("over"))))
    one = sized.groupBy("block_size").agg(sources.alias("s"))
    # Time runs in slots: a source adds its share to the pace until it is used up, at `over`.
    slot_at = lambda v: f"aggregate(s, 0D, (acc, y) -> acc + y.share * least({v}, y.over))"
    window = f"named_struct('r', cast(floor({slot_at('k / x.share')} + {_EPS}) as int), 'd', cast(ceil({slot_at('(k + 1) / x.share')} - {_EPS}) as int))"
    # Tables between the steps: a filter that the optimizer derives from one would otherwise repeat the one before it inside its loops.
    timed = cut(one.withColumn("w", F.expr(f"transform(s, x -> transform(sequence(0, x.blocks - 1), k -> {window}))")).withColumn("slots", F.expr("aggregate(s, 0, (acc, x) -> acc + x.blocks)")))
    head = "get(w[i], acc.k[i])"
    choice = f"array_min(transform(sequence(0, size(s) - 1), i -> CASE WHEN acc.k[i] < size(w[i]) THEN named_struct('late', {head}.r > t, 'd', {head}.d, 'i', i) END))"
    fold = f"""aggregate(sequence(0, slots - 1),
        named_struct('k', transform(s, x -> 0), 'out', cast(array() as array<int>)),
        (acc, t) -> transform(array({choice}), c -> named_struct('k', transform(acc.k, (n, i) -> n + IF(i = c.i, 1, 0)), 'out', array_append(acc.out, c.i)))[0],
        acc -> acc.out)"""
    slots = cut(timed.select("block_size", "s", F.expr(fold).alias("order"))).select("block_size", "s", F.posexplode("order").alias("slot", "i"))
    by_source = Window.partitionBy("i").orderBy("slot")
    return slots.select(F.expr("s[i].source").alias("source"), (F.row_number().over(by_source) - 1).cast("long").alias("block"), F.col("slot").cast("long"), "block_size")


def mixed(docs: DataFrame, source: str = "source", targets: dict[str, float] | None = None, max_blocks: int = MAX_BLOCKS, min_block: int = MIN_BLOCK) -> DataFrame:
    """(doc_id, source, block, slot, place) for every row of docs: the slot of its block and its place in the block.

    Ordering by slot, place gives the mix. Each row comes once: target shares
    hold until a source runs out, and among the others after it. Null sources
    are one source ""; repeated rows have places of their own; an empty table
    gives an empty result. Sources below one block share blocks, in hashed
    order. Only doc_id and the source column are read.
    """
    shares = cut(source_shares(docs, source, targets))  # a row for each source
    total = shares.agg(F.max("docs")).first()[0] or 0
    size = block_size(total, max_blocks, min_block)
    plan = F.broadcast(schedule(lanes(shares, size), max_blocks, min_block).withColumnRenamed("source", "s").withColumnRenamed("block", "b"))
    large = F.broadcast(shares.where(F.col("n") >= size).select(F.col("source").alias("lane")))  # at most max_blocks rows, and so is the plan twice
    rows = docs.select("doc_id", F.coalesce(F.col(source), F.lit("")).alias("source"))
    rows = ranked(rows.join(large, F.col("source") == F.col("lane"), "left"), "lane", total)
    placed = rows.withColumn("block", F.floor(F.col("rank") / size)).withColumn("place", F.col("rank") % size)
    return placed.join(plan, F.col("lane").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select("doc_id", "source", "block", "slot", "place")


def order_of(docs: DataFrame, **options) -> DataFrame:
    """(_mix_doc, slot, place): the place of each doc_id in the mix; rows of one doc_id have one place, by their least source."""
    one = docs.groupBy("doc_id").agg(F.min("source").alias("source"))
    return mixed(one, **options).select(F.col("doc_id").alias("_mix_doc"), "slot", "place")


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """docs in the order of the mix: files by ranges of slots, rows by slot and place; every row once, all columns.

    The order doesn't outlast a table of many files, so the column doc_id says
    in its metadata by which options the rows were mixed; see mix_options.
    """
    own = "_mix" + uuid.uuid4().hex[:8]  # no column of docs
    where = order_of(docs, **options).select(F.struct("_mix_doc", "slot", "place").alias(own))
    joined = docs.join(where, docs["doc_id"].eqNullSafe(F.col(f"{own}._mix_doc")))
    placed = joined.repartitionByRange(f"{own}.slot", f"{own}.place").sortWithinPartitions(f"{own}.slot", f"{own}.place").select(*docs.columns)
    return placed.withMetadata("doc_id", {"mix": json.dumps(options)})


def mix_options(docs: DataFrame) -> dict | None:
    """The options by which in_mix_order made docs, also after a table was written and read; None if it didn't."""
    metadata = docs.schema["doc_id"].metadata or {}
    return json.loads(metadata["mix"]) if "mix" in metadata else None
