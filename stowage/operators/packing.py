"""Bins, aggregates, containers and batches."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import columns as c
from ..plans.primitives import next_fit
from ..registry import query
from .joins import free_pieces, free_sub_pieces, verify_blocks
from .rows import split_unservable


class _FirstFit:
    """Bins by first fit: the first open one with room, found in a tree of free space that grows with the bins."""

    def __init__(self, cap: int):
        self.cap, self.width = cap, 1024
        self.free = array("q", [cap]) * (2 * self.width)

    def place(self, size: int) -> int:
        if self.free[1] < size:  # all bins are open: as many again
            free = array("q", [self.cap]) * (4 * self.width)
            level = 1
            while level <= self.width:
                free[2 * level : 3 * level] = self.free[level : 2 * level]
                level *= 2
            self.free, self.width = free, 2 * self.width
        free, node = self.free, 1
        while node < self.width:
            node = 2 * node if free[2 * node] >= size else 2 * node + 1
        out = node - self.width
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return out


def _first_fit(sizes: list[int], cap: int) -> list[int]:
    """The bin of each size in turn."""
    bins = _FirstFit(cap)
    return [bins.place(size) for size in sizes]


def _fitted(group: str, size: str, cap: int):
    """Rows of groups in order with their bin; of a group nothing but the free space of its bins is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = bins = None
        for batch in batches:
            out = []
            for name, n in zip(batch.column(group).to_pylist(), batch.column(size).to_pylist()):
                if bins is None or name != at:
                    at, bins = name, _FirstFit(cap)
                out.append(bins.place(n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "bin"])

    return run


def pack_ffd(df: DataFrame, cap: int, group: str, key: str = "object_id", size: str = "raw_size") -> DataFrame:
    """(group, key, bin, place): first-fit-decreasing within each group; larger first, ties by key; sizes above cap are left out.

    First-fit-decreasing is sequential, so a group is one task: a long run is
    sharded by a finer group, which changes the bins but never the cap. Spark
    sorts; the task holds a number or two for each bin, whatever the rows.
    """
    kinds = dict(df.dtypes)
    rows = df.where(F.col(size) <= cap).select(group, key, size).repartition(group).sortWithinPartitions(F.col(group), F.col(size).desc(), F.col(key))
    packed = rows.mapInArrow(_fitted(group, size, cap), f"{group} {kinds[group]}, {key} {kinds[key]}, {size} {kinds[size]}, bin long")
    place = F.row_number().over(Window.partitionBy(group, "bin").orderBy(key)) - 1
    return packed.select(group, key, "bin", place.cast("long").alias("place"))


def pack_ffd_sharded(df: DataFrame, cap: int, group: str, shard_rows: int, key: str = "object_id", size: str = "raw_size") -> DataFrame:
    """As pack_ffd, with each group cut into shards of about shard_rows rows, so that a group with most of the rows is many tasks.

    Rows are dealt by a digest of their key, so every shard has the same mix of
    sizes and is packed exactly on its own; bins of shard s are numbered s, s +
    shards, and so on. Of a shard at most one bin is half full or less, so there
    are at most 2 * total / cap bins and one more for each shard. Groups of up
    to shard_rows rows are packed as pack_ffd packs them.
    """
    fit = df.where(F.col(size) <= cap).select(group, key, size)
    shards = fit.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("_n"))
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    dealt = fit.join(shards, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_shard", digest % F.col("_n"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, key], ascending=[False, True], kind="stable")
        out = pdf[[group, key]].assign(bin=np.array(_first_fit(pdf[size].tolist(), cap), dtype=np.int64) * pdf["_n"].to_numpy() + pdf["_shard"].to_numpy())
        out["place"] = out.sort_values(key).groupby("bin").cumcount()
        return out

    kinds = dict(df.dtypes)
    return dealt.drop("_g").groupBy(group, "_shard").applyInPandas(pack, f"{group} {kinds[group]}, {key} {kinds[key]}, bin long, place long")


_FFD = """RECURSIVE o AS (SELECT source, object_id, raw_size, row_number() OVER (PARTITION BY source ORDER BY raw_size DESC, object_id) AS i FROM objects WHERE raw_size <= 20000),
    f AS (SELECT source, 0::BIGINT AS i, []::BIGINT[] AS free, 0::BIGINT AS object_id, 0::BIGINT AS bin FROM (SELECT DISTINCT source FROM o)
        UNION ALL SELECT source, i, CASE WHEN p > len(free) THEN list_append(free, 20000 - raw_size) ELSE list_concat(list_append(free[:p - 1], free[p] - raw_size), free[p + 1:]) END, object_id, p - 1
        FROM (SELECT f.source, o.i, f.free, o.object_id, o.raw_size, coalesce(list_position(list_transform(f.free, lambda x: x >= o.raw_size), true), len(f.free) + 1) AS p FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1))
    SELECT source, object_id, bin, row_number() OVER (PARTITION BY source, bin ORDER BY object_id) - 1 AS place FROM f WHERE i > 0"""


@query("pk1_pack_ffd", _FFD)
def pk1(spark, d):
    return pack_ffd(fx.objects(spark, d), 20000, "source")


_SHARD_ROWS = 64
_SHARDED = f"""RECURSIVE n AS (SELECT source, CAST(ceil(count(*) / {_SHARD_ROWS}.0) AS BIGINT) AS n FROM objects WHERE raw_size <= 20000 GROUP BY source), q AS (SELECT source, object_id, raw_size, n, ('0x' || md5(object_id::VARCHAR)[1:8])::BIGINT % n AS shard FROM objects JOIN n USING (source) WHERE raw_size <= 20000),
    o AS (SELECT *, row_number() OVER (PARTITION BY source, shard ORDER BY raw_size DESC, object_id) AS i FROM q),
    f AS (SELECT source, shard, 0::BIGINT AS n, 0::BIGINT AS i, []::BIGINT[] AS free, 0::BIGINT AS object_id, 0::BIGINT AS bin FROM (SELECT DISTINCT source, shard FROM o)
        UNION ALL SELECT source, shard, n, i, CASE WHEN p > len(free) THEN list_append(free, 20000 - raw_size) ELSE list_concat(list_append(free[:p - 1], free[p] - raw_size), free[p + 1:]) END, object_id, p - 1
        FROM (SELECT f.source, f.shard, o.n, o.i, f.free, o.object_id, o.raw_size, coalesce(list_position(list_transform(f.free, lambda x: x >= o.raw_size), true), len(f.free) + 1) AS p FROM f JOIN o ON o.source = f.source AND o.shard = f.shard AND o.i = f.i + 1))
    SELECT source, object_id, bin * n + shard AS bin, row_number() OVER (PARTITION BY source, shard, bin ORDER BY object_id) - 1 AS place FROM f WHERE i > 0"""


@query("pk1_pack_sharded", _SHARDED)
def pk1_sharded(spark, d):
    return pack_ffd_sharded(fx.objects(spark, d), 20000, "source", _SHARD_ROWS)


def pack_next_fit(df: DataFrame, order: list, size: str, cap: int) -> DataFrame:
    """df's rows not above cap with bin: bins in order, each closed when the next row would exceed cap."""
    return next_fit(df.where(F.col(size) <= cap), order, F.col(size), cap)


def _next_fit_sql(source: str, key: str, cap: int) -> str:
    return f"""RECURSIVE o AS (SELECT {key}, raw_size, row_number() OVER (ORDER BY {key}) AS i FROM {source} WHERE raw_size <= {cap}),
    f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS bin, NULL::BIGINT AS {key} UNION ALL SELECT o.i, CASE WHEN used + raw_size > {cap} THEN raw_size ELSE used + raw_size END, CASE WHEN used + raw_size > {cap} THEN bin + 1 ELSE bin END, o.{key} FROM f JOIN o ON o.i = f.i + 1)"""


@query("pk2_pack_next_fit", f"{_next_fit_sql('objects', 'object_id', 100000)} SELECT object_id, bin FROM f WHERE i > 0")
def pk2(spark, d):
    return pack_next_fit(fx.objects(spark, d).select("object_id", "raw_size"), ["object_id"], "raw_size", 100000).select("object_id", "bin")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: str) -> None:
    found = duplicate_keys(df, key).limit(5).collect()
    if found:
        raise ValueError(f"{key} is not unique: {', '.join(str(r[0]) for r in found)}")


@query("pk3_duplicate_keys", "SELECT digest_hex, count(*) AS n FROM objects GROUP BY 1 HAVING count(*) > 1")
def pk3(spark, d):
    return duplicate_keys(fx.objects(spark, d), "digest_hex")


def append_aggregates(free: DataFrame, existing: DataFrame, cap: int) -> DataFrame:
    """(sub_piece_cid, idx, oversized): new aggregates numbered above the existing ones; padded sizes share the budget, and sub-pieces whose own is above it are oversized and have none."""
    base = existing.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("base"))
    padded = free.select("sub_piece_cid", c.padded_size(F.col("raw_size")).alias("padded"))
    packed = pack_next_fit(padded, ["sub_piece_cid"], "padded", cap).join(F.broadcast(base)).select("sub_piece_cid", (F.col("base") + F.col("bin")).alias("idx"), F.lit(False).alias("oversized"))
    return packed.union(padded.where(F.col("padded") > cap).select("sub_piece_cid", F.lit(None).cast("long"), F.lit(True)))


#: SQL for a padded size.
PADDED_SQL = "(1::BIGINT << CAST(ceil(log2(greatest(128, ceil(raw_size * 128 / 127.0)))) AS INT))"
_FREE = "fp AS (SELECT sub_piece_cid, {} AS raw_size FROM sub_pieces WHERE status = 'built' AND sub_piece_cid NOT IN (SELECT sub_piece_cid FROM aggregate_members WHERE aggregate_idx % 10 = 0))".format(PADDED_SQL)


@query("pk4_append_aggregates", _next_fit_sql("fp", "sub_piece_cid", 5 << 20).replace("RECURSIVE o", f"RECURSIVE {_FREE}, o") + f" SELECT sub_piece_cid, bin + (SELECT max(idx) + 1 FROM aggregates) AS idx, false AS oversized FROM f WHERE i > 0 UNION ALL SELECT sub_piece_cid, NULL, true FROM fp WHERE raw_size > {5 << 20}")
def pk4(spark, d):
    return append_aggregates(free_sub_pieces(fx.sub_pieces(spark, d), fx.aggregate_members(spark, d).where("aggregate_idx % 10 = 0")), fx.aggregates(spark, d), 5 << 20)


@query("pk4_append_padded", _next_fit_sql("fp", "object_id", 8192).replace("RECURSIVE o", f"RECURSIVE fp AS (SELECT object_id, {PADDED_SQL} AS raw_size FROM objects), o") + " SELECT object_id AS sub_piece_cid, bin AS idx, false AS oversized FROM f WHERE i > 0 UNION ALL SELECT object_id, NULL, true FROM fp WHERE raw_size > 8192")
def pk4_padded(spark, d):
    """Every object as a sub-piece, under a budget that many exceed by their padding alone."""
    return append_aggregates(fx.objects(spark, d).select(F.col("object_id").alias("sub_piece_cid"), "raw_size"), fx.aggregates(spark, d).limit(0), 8192)


def wrap_passthrough(free: DataFrame) -> DataFrame:
    """One built sub-piece for each free piece with a URL."""
    servable, _ = split_unservable(free)
    return servable.select(F.col("piece_cid").alias("sub_piece_cid"), F.col("cid").alias("member_cid"), "raw_size", "url", F.lit("built").alias("status"))


@query("pk5_wrap_passthrough", "SELECT piece_cid AS sub_piece_cid, cid AS member_cid, raw_size, url, 'built' AS status FROM pieces WHERE status = 'done' AND url IS NOT NULL AND k % 3 <> 0")
def pk5(spark, d):
    p = fx.pieces(spark, d)
    return wrap_passthrough(free_pieces(p, p.where("k % 3 = 0").select(F.col("cid").alias("member_cid"))))


def assemble_plan(bins: DataFrame, objects: DataFrame) -> DataFrame:
    """bins (group, bin, id), objects (id, digest_hex, raw_size): each member's byte offset in canonical order, and its bin's length."""
    w = Window.partitionBy("group", "bin")
    before = w.orderBy("digest_hex", "id").rowsBetween(Window.unboundedPreceding, -1)
    return bins.join(objects, "id").select("group", "bin", "id", "digest_hex", F.coalesce(F.sum("raw_size").over(before), F.lit(0)).alias("offset"), "raw_size", F.sum("raw_size").over(w).alias("total"))


def container_digest(plan: DataFrame, payloads: DataFrame) -> DataFrame:
    """(group, bin, sha256) of each bin's payloads in order; a bin is bounded by its cap."""
    rows = plan.join(payloads, "id").groupBy("group", "bin").agg(F.array_sort(F.collect_list(F.struct("offset", "id", "payload"))).alias("m"))
    return rows.select("group", "bin", F.sha2(F.aggregate("m", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["payload"])), 256).alias("sha256"))


#: The container plan of every source in SQL, as a CTE asm.
ASSEMBLED = _FFD.rsplit("SELECT source, object_id, bin", 1)[0].rstrip() + """, asm AS (SELECT f.source AS "group", bin, f.object_id AS id, digest_hex, coalesce(sum(x.raw_size) OVER (PARTITION BY f.source, bin ORDER BY digest_hex, f.object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset", x.raw_size, sum(x.raw_size) OVER (PARTITION BY f.source, bin) AS total FROM f JOIN objects x ON f.object_id = x.object_id WHERE i > 0)"""


@query("pk6_assemble_plan", ASSEMBLED + " SELECT * FROM asm")
def pk6(spark, d):
    o = fx.objects(spark, d)
    bins = pack_ffd(o, 20000, "source").select(F.col("source").alias("group"), "bin", F.col("object_id").alias("id"))
    return assemble_plan(bins, o.select(F.col("object_id").alias("id"), "digest_hex", "raw_size"))


@query("pk6_container_digest", ASSEMBLED + ", t AS (SELECT doc_id, lower(hex(encode(text))) AS h FROM documents) SELECT \"group\", bin, sha256(unhex(string_agg(h, '' ORDER BY \"offset\", id))) AS sha256 FROM asm JOIN t ON doc_id = id GROUP BY \"group\", bin")
def pk6b(spark, d):
    o = fx.objects(spark, d)
    return container_digest(pk6(spark, d), o.select(F.col("object_id").alias("id"), "payload"))


def validate_members(blocks: DataFrame, bins: DataFrame) -> DataFrame:
    """(bin, ok, failed): bins of which a block is empty or doesn't verify fail, with the members at fault."""
    bad = verify_blocks(blocks).select("node", (F.col("valid") & (F.octet_length("bytes") > 0)).alias("good"))
    j = bins.join(bad, "node", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    return j.groupBy("bin").agg(F.bool_and("good").alias("ok"), F.array_sort(F.collect_list(F.when(~F.col("good"), F.col("node")))).alias("failed"))


@query("pk7_validate_members", "x AS (SELECT parent AS bin, child AS node FROM links), g AS (SELECT node FROM blocks WHERE sha256(bytes) = digest) SELECT bin, bool_and(node IN (SELECT node FROM g)) AS ok, coalesce(list(node ORDER BY node) FILTER (node NOT IN (SELECT node FROM g)), []) AS failed FROM x GROUP BY bin")
def pk7(spark, d):
    return validate_members(fx.blocks(spark, d), fx.links(spark, d).select(F.col("parent").alias("bin"), F.col("child").alias("node")))


def batches(members: DataFrame, n: int = 32) -> DataFrame:
    w = Window.partitionBy("aggregate_idx").orderBy("segment_index")
    b = F.floor((F.row_number().over(w) - 1) / n)
    return members.withColumn("batch", b).groupBy("aggregate_idx", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "sub_piece_cid"))), lambda x: x["sub_piece_cid"]).alias("ids"))


@query("pk8_batches", "SELECT aggregate_idx, segment_index // 3 AS batch, list(sub_piece_cid ORDER BY segment_index) AS ids FROM aggregate_members GROUP BY 1, 2")
def pk8(spark, d):
    return batches(fx.aggregate_members(spark, d), 3)


def requeue(chunks: DataFrame, deferred: DataFrame, n: int) -> DataFrame:
    """(ctx, chunk, pieces): deferred ids (ctx, piece) in order, cut into chunks of n after the last one."""
    last = chunks.groupBy("ctx").agg(F.max("chunk").alias("last"))
    w = Window.partitionBy("ctx").orderBy("piece")
    rows = deferred.withColumn("c", F.floor((F.row_number().over(w) - 1) / n)).groupBy("ctx", "c").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return rows.join(last, "ctx", "left").select("ctx", (F.coalesce("last", F.lit(-1)) + 1 + F.col("c")).alias("chunk"), "pieces")


@query("pk9_requeue", "d AS (SELECT DISTINCT ctx, unnest(piece_ids) AS piece FROM chunks WHERE NOT committed), r AS (SELECT *, (row_number() OVER (PARTITION BY ctx ORDER BY piece) - 1) // 3 AS c FROM d), l AS (SELECT ctx, max(chunk) AS m FROM chunks GROUP BY ctx) SELECT ctx, m + 1 + c AS chunk, list(piece ORDER BY piece) AS pieces FROM r JOIN l USING (ctx) GROUP BY ctx, m, c")
def pk9(spark, d):
    ch = fx.chunks(spark, d)
    return requeue(ch, ch.where("NOT committed").select("ctx", F.explode("piece_ids").alias("piece")).distinct(), 3)


def carve_failed(chunks: DataFrame, failed: DataFrame) -> DataFrame:
    """Chunks without their failed ids, which are deferred; a chunk that is left empty is committed."""
    f = failed.groupBy("ctx").agg(F.collect_set("piece").alias("f"))
    j = chunks.join(f, "ctx", "left").withColumn("f", F.coalesce("f", F.array().cast("array<string>")))
    left = F.array_except("piece_ids", "f")
    return j.select("ctx", "chunk", left.alias("kept"), F.array_sort(F.array_intersect("piece_ids", "f")).alias("deferred"), (F.col("committed") | (F.size(left) == 0)).alias("committed"))


@query("pk10_carve_failed", """s AS (SELECT ctx, chunk, committed, piece_ids AS p FROM chunks), u AS (SELECT ctx, chunk, unnest(p) AS x FROM s), g AS (SELECT ctx, chunk, coalesce(list(DISTINCT x ORDER BY x) FILTER (x NOT LIKE '%1'), []) AS kept, coalesce(list(DISTINCT x ORDER BY x) FILTER (x LIKE '%1'), []) AS deferred FROM u GROUP BY 1, 2)
    SELECT ctx, chunk, kept, deferred, committed OR len(kept) = 0 AS committed FROM g JOIN s USING (ctx, chunk)""")
def pk10(spark, d):
    ch = fx.chunks(spark, d)
    failed = ch.select("ctx", F.explode("piece_ids").alias("piece")).where("piece LIKE '%1'").distinct()
    return carve_failed(ch, failed).withColumn("kept", F.array_sort("kept"))


def utilisation(bins: DataFrame) -> DataFrame:
    return bins.groupBy("group", "bin").agg(F.count("*").alias("members"), F.sum("raw_size").alias("used"))


@query("ag15_utilisation", _FFD.replace("SELECT source, object_id, bin, row_number() OVER (PARTITION BY source, bin ORDER BY object_id) - 1 AS place FROM f WHERE i > 0", "SELECT f.source AS \"group\", bin, count(*) AS members, sum(x.raw_size) AS used FROM f JOIN objects x ON f.object_id = x.object_id WHERE i > 0 GROUP BY 1, 2"))
def ag15(spark, d):
    return utilisation(pk6(spark, d))
