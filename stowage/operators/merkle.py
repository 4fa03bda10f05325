"""Commitments: decoding, Merkle roots by aligned subtrees, roots of aggregates and of objects."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import columns as c
from ..plans.primitives import Fold, combine, cut, few_rows, merkle_roots, merkle_sql, places_within, zero_nodes
from ..registry import query

#: Raw bytes of a chunk: 127 * 2^k, so that a chunk is a whole subtree.
CHUNK = 127 << 10


def _decode(text: str | None) -> tuple[int, int, bytes] | None:
    """(padding, height, root) of a commitment id in base32, or nothing."""
    try:
        if not text or text[0] != "b":
            return None
        raw = base64.b32decode(text[1:].upper() + "=" * (-len(text[1:]) % 8))
    except ValueError:
        return None
    if raw[:2] != b"\x01\x55" or raw[2:4] != b"\x91\x20":
        return None
    at, size = 4, raw[4] if len(raw) > 4 else 0
    digest = raw[at + 1 :]
    if len(digest) != size or size < 34:
        return None
    n = shift = i = 0
    while i < 9:
        n |= (digest[i] & 127) << shift
        shift += 7
        i += 1
        if digest[i - 1] < 128:
            break
    rest = digest[i:]
    return (n, rest[0], rest[1:]) if len(rest) == 33 else None


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [_decode(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] if g else None for g in got], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary())))], ["id", "padding", "height", "root"])


def decode_commitments(df: DataFrame, column: str) -> DataFrame:
    """(id, padding, height, root, padded) of each distinct id; null parts where it isn't one."""
    out = df.select(F.col(column).alias("id")).distinct().mapInArrow(_decoded, "id string, padding long, height int, root binary")
    return out.withColumn("padded", F.call_function("shiftleft", F.lit(32).cast("long"), F.col("height")))


def encode_commitment(padding: int, height: int, root: bytes) -> str:
    n, out = padding, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    digest = bytes(out) + bytes([height]) + root
    return "b" + base64.b32encode(b"\x01\x55\x91\x20" + bytes([len(digest)]) + digest).decode().lower().rstrip("=")


def _expand(raw: bytes) -> bytes:
    """Each 127 bytes as 128: four runs of 254 bits, each followed by two zero bits, little-endian."""
    groups = np.frombuffer(raw + bytes(-len(raw) % 127), np.uint8).reshape(-1, 127)
    bits = np.unpackbits(groups, axis=1, bitorder="little").reshape(len(groups), 4, 254)
    return np.packbits(np.pad(bits, ((0, 0), (0, 0), (0, 2))).reshape(len(groups), 1024), axis=1, bitorder="little").tobytes()


def _subtrees(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros = zero_nodes(40)
        for batch in few_rows(batches):
            ids, places, heights, nodes, tops = [], [], [], [], []
            for i, raw, top in zip(*(batch.column(c).to_pylist() for c in ("id", "payload", "top"))):
                raw = raw or b""
                size = min(chunk, (127 << top) // 4)
                height = (size // 127 * 4).bit_length() - 1
                for k, at in enumerate(range(0, max(1, len(raw)), size)):
                    expanded = _expand(raw[at : at + size] or b"\0")
                    level = [expanded[j : j + 32] for j in range(0, len(expanded), 32)]
                    for h in range(height):
                        if len(level) % 2:
                            level.append(zeros[h])
                        level = [combine(level[j], level[j + 1]) for j in range(0, len(level), 2)]
                    ids.append(i)
                    places.append(k)
                    heights.append(height)
                    nodes.append(level[0])
                    tops.append(top)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("id").type), pa.array(places, pa.int64()), pa.array(heights, pa.int32()), pa.array(nodes, pa.binary()), pa.array(tops, pa.int32())], ["id", "pos", "height", "node", "top"])

    return run


def commit_objects(objects: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, raw_size, height, padding, root) of objects (id, payload): chunks become subtree roots where they lie, and only these travel."""
    raw = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")
    kind = dict(objects.dtypes)["id"]
    nodes = objects.select("id", "payload", c.tree_height(raw).alias("top")).mapInArrow(_subtrees(chunk), f"id {kind}, pos long, height int, node binary, top int")
    sized = objects.select("id", raw.alias("raw_size"))
    roots = merkle_roots(nodes, ["id"])
    return sized.join(roots, "id").select("id", "raw_size", c.tree_height(F.col("raw_size")).alias("height"), c.padding(F.col("raw_size")).alias("padding"), F.lower(F.hex("root")).alias("root"))


#: SQL for the height of raw_size bytes' tree, and for the varint of n in hex.
TOP_SQL = "CAST(ceil(log2(greatest(128, ceil(raw_size * 128 / 127.0)))) AS INT) - 5"
_NIBBLES = "array_to_string(list_transform(string_split(r, ''), lambda h: right('000' || bin(('0x' || h)::BIGINT), 4)), '')"


def leaves_sql(raw: str) -> str:
    """CTEs from rows (id, h: bytes in hex, raw_size, top) to leaves: 127 bytes as four nodes, their bits from the last one back in runs of 254."""
    return f"""raw AS MATERIALIZED ({raw}),
    groups AS (SELECT id, top, i, array_to_string(list_reverse(regexp_extract_all(rpad(substr(h, i * 254 + 1, 254), 254, '0'), '..')), '') AS r FROM raw, unnest(range(CAST(greatest(1, ceil(raw_size / 127.0)) AS BIGINT))) AS u(i)),
    bits AS (SELECT id, top, i * 4 + j AS pos, '00' || substr(b, 1016 - 254 * j - 253, 254) AS b FROM (SELECT id, top, i, {_NIBBLES} AS b FROM groups), range(4) AS q(j)),
    leaves AS MATERIALIZED (SELECT id, 0 AS height, pos, array_to_string(list_reverse(list_transform(range(32), lambda k: printf('%02x', list_sum(list_transform(range(8), lambda j: CASE WHEN b[k * 8 + j + 1] = '1' THEN 128 >> j ELSE 0 END))::BIGINT))), '') AS node, top FROM bits)"""


_LEAVES = leaves_sql(f"SELECT object_id AS id, lower(hex(encode(text))) AS h, raw_size, {TOP_SQL} AS top FROM (SELECT doc_id AS object_id, text, strlen(text) AS raw_size FROM documents)")
_COMMITTED = f"{_LEAVES}, {merkle_sql('leaves', 'id', 20)}"


@query("mk1_commit_objects", f"{_COMMITTED} SELECT id, raw_size, top AS height, (32::BIGINT << top) // 128 * 127 - raw_size AS padding, root FROM raw JOIN roots USING (id)")
def mk1(spark, d):
    return commit_objects(fx.objects(spark, d).select(F.col("object_id").alias("id"), "payload"))


VARINT_SQL = "CASE WHEN n < 128 THEN printf('%02x', n) WHEN n < 16384 THEN printf('%02x%02x', (n & 127) | 128, n >> 7) ELSE printf('%02x%02x%02x', (n & 127) | 128, ((n >> 7) & 127) | 128, n >> 14) END"


@query("mk2_decode_commitments", f"""{_COMMITTED}, e AS (SELECT DISTINCT top, (32::BIGINT << top) // 128 * 127 - raw_size AS n, root FROM raw JOIN roots USING (id)), d AS (SELECT *, {VARINT_SQL} || printf('%02x', top) || root AS body FROM e), x AS (SELECT *, '01559120' || printf('%02x', length(body) // 2) || body AS hx FROM d)
    SELECT CASE length(hx) WHEN 78 THEN {fx.base32_sql("x.hx", 63)} WHEN 80 THEN {fx.base32_sql("x.hx", 64)} ELSE {fx.base32_sql("x.hx", 66)} END AS id, n AS padding, top AS height, unhex(root) AS root, 32::BIGINT << top AS padded FROM x""")
def mk2(spark, d):
    o = commit_objects(fx.objects(spark, d).select(F.col("object_id").alias("id"), "payload"))

    def encoded(batches):
        for b in batches:
            ids = [encode_commitment(p, h, bytes.fromhex(r)) for p, h, r in zip(*(b.column(x).to_pylist() for x in ("padding", "height", "root")))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string())], ["cid"])

    return decode_commitments(o.select("padding", "height", "root").mapInArrow(encoded, "cid string"), "cid")


def trees(members: DataFrame, dealt: bool = False) -> DataFrame:
    """(key, n_members, raw_size, m) of members (key, order, height, node, raw_size, id): m has a key's members, larger first, ties in order. One shuffle, none where the rows are dealt by key already."""
    rows = members.where("key IS NOT NULL")
    m = F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("h"), "order", "id", "node")))
    return (rows if dealt else rows.repartition("key")).groupBy("key").agg(F.count("*").alias("n_members"), F.sum("raw_size").alias("raw_size"), m.alias("m"))


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root of each row's tree where none is given; offsets add up in the least unit, and the height comes from their sum."""
    zeros = zero_nodes(64)
    for batch in batches:
        m, given = batch.column("m"), batch.column("root").to_pylist()
        ends, values = m.offsets.to_pylist(), m.values
        heights, nodes = (values.field(values.type.get_field_index(n)).to_pylist() for n in ("h", "node"))
        roots = []
        for i, stands in enumerate(batch.column("stands").to_pylist()):
            if stands:
                roots.append(given[i])
                continue
            fold, used = Fold(zeros, True), 0
            for k in range(ends[i], ends[i + 1]):
                height = -heights[k]
                fold.push(height, used >> height, nodes[k])
                used += 1 << height
            roots.append(fold.root(max((used - 1).bit_length(), -heights[ends[i]])).hex())
        ids = pa.ListArray.from_arrays(m.offsets, values.field(values.type.get_field_index("id")))
        names = [n for n in batch.schema.names if n not in ("m", "root")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(roots, pa.string()), ids], [*names, "root", "ids"])


def _roots(rows: DataFrame) -> DataFrame:
    """rows (m, and root where stands is true) with the root of each tree and its ids in place of m."""
    names = [n for n in rows.columns if n not in ("m", "root")]
    kinds = dict(rows.dtypes)
    member = next(f for f in rows.schema["m"].dataType.elementType.fields if f.name == "id").dataType.simpleString()
    return rows.mapInArrow(_rooted, ", ".join(f"`{n}` {kinds[n]}" for n in names) + f", root string, ids array<{member}>")


def aggregate_roots(members: DataFrame, dealt: bool = False) -> DataFrame:
    """(key, root, n_members, raw_size, height, padding, ids) of members (key, order, height, node, raw_size, id).

    The tree's height comes from the padded sizes; height and padding of the
    envelope from the sum of raw sizes, and the two may differ.
    """
    roots = _roots(trees(members, dealt).select("*", F.lit(None).cast("string").alias("root"), F.lit(False).alias("stands")))
    return roots.select("key", "root", "n_members", "raw_size", c.tree_height(F.col("raw_size")).alias("height"), c.padding(F.col("raw_size")).alias("padding"), "ids")


def tree_members(spark, d, kept: bool = False):
    """Members dealt by key; nodes are made where they have arrived. kept is for several readers: the rows are a table without nodes."""
    size = F.col("raw_size")
    rows = fx.aggregate_members(spark, d).join(fx.sub_pieces(spark, d), "sub_piece_cid").select(F.col("aggregate_idx").alias("key"), F.col("segment_index").alias("order"), "raw_size", F.col("sub_piece_cid").alias("id"))
    return (cut(rows) if kept else rows).repartition("key").select("key", "order", c.tree_height(size).alias("height"), F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("node"), "raw_size", "id")


LAID_SQL = f"""m AS (SELECT aggregate_idx AS key, segment_index AS o, raw_size, sub_piece_cid, {TOP_SQL} AS height FROM aggregate_members JOIN sub_pieces USING (sub_piece_cid)), t AS (SELECT key, sum(1::BIGINT << height)::BIGINT AS total, max(height) AS most, sum(raw_size) AS raw_size, count(*) AS n_members, list(sub_piece_cid ORDER BY height DESC, o) AS ids FROM m GROUP BY key),
    laid AS (SELECT m.key, height, coalesce(sum(1::BIGINT << height) OVER (PARTITION BY m.key ORDER BY height DESC, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT >> height AS pos, sha256(sub_piece_cid::VARCHAR) AS node, CASE WHEN total = 1 THEN most ELSE greatest(most, length(bin(total - 1))) END AS top FROM m JOIN t USING (key)),
    {merkle_sql("laid", "key", 26)}"""


@query("mk4_aggregate_roots", f"{LAID_SQL} SELECT key, root, n_members, raw_size, {TOP_SQL} AS height, (32::BIGINT << ({TOP_SQL})) // 128 * 127 - raw_size AS padding, ids FROM t JOIN roots USING (key)")
def mk4(spark, d):
    return aggregate_roots(tree_members(spark, d), dealt=True)


@query("mk4_aggregate_order", "m AS (SELECT aggregate_idx AS key, segment_index, raw_size, sub_piece_cid, CAST(ceil(log2(greatest(128, ceil(raw_size * 128 / 127.0)))) AS INT) - 5 AS h FROM aggregate_members JOIN sub_pieces USING (sub_piece_cid)) SELECT key, count(*) AS n_members, sum(raw_size) AS raw_size, list(sub_piece_cid ORDER BY h DESC, segment_index) AS ids FROM m GROUP BY key")
def mk4b(spark, d):
    return aggregate_roots(tree_members(spark, d), dealt=True).select("key", "n_members", "raw_size", "ids")


@query("mk3_merkle_root", f"n AS (SELECT source AS key, 0 AS height, row_number() OVER (PARTITION BY source ORDER BY object_id) - 1 AS pos, digest_hex AS node, CASE WHEN count(*) OVER (PARTITION BY source) = 1 THEN 0 ELSE length(bin(count(*) OVER (PARTITION BY source) - 1)) END AS top FROM objects), {merkle_sql('n', 'key', 24)} SELECT key, root FROM roots")
def mk3(spark, d):
    o = fx.objects(spark, d).select(F.col("source").alias("key"), "object_id", F.unhex("digest_hex").alias("node"))
    sizes = o.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("n"))
    placed = places_within(o, ["key"], ["object_id"])
    n = F.col("n")
    top = placed.join(sizes, F.col("key").eqNullSafe(F.col("of"))).select("key", F.lit(0).alias("height"), F.col("place").alias("pos"), "node", F.when(n == 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int").alias("top"))
    return merkle_roots(top, ["key"]).select("key", F.lower(F.hex("root")).alias("root"))


def check_roots(stored: DataFrame, members: DataFrame, dealt: bool = False) -> DataFrame:
    """(key, ok, root): stored (key, root) against the roots computed again from members; root is the one computed, null where a key has no member."""
    now = aggregate_roots(members, dealt).select("key", F.col("root").alias("now"))
    return stored.join(now, "key", "left").select("key", F.coalesce(F.col("root") == F.col("now"), F.lit(False)).alias("ok"), F.col("now").alias("root"))


def _digest(m) -> Column:
    """Digest of the members m of a tree in order."""
    each = lambda x: F.struct(x["order"].alias("order"), F.concat_ws("/", x["order"].cast("string"), (-x["h"]).cast("string"), F.hex(x["node"])).alias("m"))
    return F.sha2(F.array_join(F.transform(F.array_sort(F.transform(m, each)), lambda x: x["m"]), ","), 256)


def member_digests(members: DataFrame, dealt: bool = False) -> DataFrame:
    """(key, digest) of each tree's members in order: it changes when a member, its height or its order does."""
    return trees(members, dealt).select("key", _digest(F.col("m")).alias("digest"))


def digested_roots(members: DataFrame, dealt: bool = False) -> DataFrame:
    """(key, digest, root) of each tree from one pass over members."""
    rows = trees(members, dealt).select("key", _digest(F.col("m")).alias("digest"), "m", F.lit(None).cast("string").alias("root"), F.lit(False).alias("stands"))
    return _roots(rows).select("key", "digest", "root")


def replayed_roots(members: DataFrame, kept: DataFrame, dealt: bool = False) -> DataFrame:
    """(key, digest, root, replayed) of all trees now: roots of kept (key, digest, root) stand where the members' digest is the same, and only the others are computed. Members travel once."""
    old = kept.groupBy("key").agg(F.collect_list(F.struct("digest", "root")).alias("old"))
    now = trees(members, dealt).select("key", _digest(F.col("m")).alias("digest"), "m").join(old, "key", "left")
    same = F.filter(F.coalesce("old", F.array().cast(dict(old.dtypes)["old"])), lambda x: x["digest"] == F.col("digest"))
    rows = now.withColumn("same", same).select("key", "digest", "m", F.get("same", F.lit(0))["root"].alias("root"), (F.size("same") > 0).alias("stands"))
    return _roots(rows).select("key", "digest", "root", (~F.col("stands")).alias("replayed"))


def replay_roots(members: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, digest, root) of all trees now, keys that were computed), as replayed_roots."""
    t = cut(replayed_roots(members, kept))
    return t.select("key", "digest", "root"), t.where("replayed").select("key")


@query("mk5_check_roots", f"{LAID_SQL} SELECT key, key % 9 <> 0 AS ok, root FROM roots")
def mk5(spark, d):
    """Stored roots of which every ninth was altered, against those that the members give; SQL makes its own."""
    m = tree_members(spark, d, kept=True)
    stored = cut(aggregate_roots(m, dealt=True).select("key", F.when(F.col("key") % 9 == 0, F.lit("0" * 64)).otherwise(F.col("root")).alias("root")))
    return check_roots(stored, m, dealt=True)


@query("mk5_replay_changed", f"{LAID_SQL} SELECT key, root, key % 5 = 0 OR key % 7 = 0 AS computed FROM roots")
def mk5_replay(spark, d):
    """Roots kept from before for all but some new aggregates; of those kept, some have other members now."""
    m = tree_members(spark, d, kept=True)
    k = F.col("key")
    before = m.where(k % 5 != 0).withColumn("node", F.when(k % 7 == 0, F.unhex(F.lit("ab" * 32))).otherwise(F.col("node")))
    kept = digested_roots(before, dealt=True)
    return replayed_roots(m, kept, dealt=True).select("key", "root", F.col("replayed").alias("computed"))
