"""Plan, pack and import as jobs over the state: each reads one version and publishes the next one whole, or refuses."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fixtures as fx
from ..operators import intake, joins, merkle, packing
from ..operators.aggregations import first_success, record_outcome
from ..registry import query
from ..sources import containers, tables
from ..sources.state import Refused, State, refuse
from .primitives import cut, merkle_sql, shared_dir

#: Raw bytes of a sub-piece at most: a limit of providers.
RAW_LIMIT = 1_069_547_520


@F.pandas_udf(StringType())
def commitment_id(padding: pd.Series, height: pd.Series, root: pd.Series) -> pd.Series:
    """The id in base32 of a commitment with its root in hex."""
    return pd.Series([merkle.encode_commitment(p, h, bytes.fromhex(r)) for p, h, r in zip(padding, height, root)], dtype=object)


@dataclass(frozen=True)
class Planned:
    """What a job adds: sub-pieces with members, aggregates with members, and the ids of pieces that no aggregate can hold."""

    sub_pieces: DataFrame
    sub_piece_members: DataFrame
    aggregates: DataFrame
    aggregate_members: DataFrame
    oversized: DataFrame


def wrap(pieces: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sub-pieces, their members): one for each done piece that is in none yet and has a URL to pull it from."""
    free = joins.free_pieces(pieces, members).where("piece_cid IS NOT NULL AND raw_size IS NOT NULL")
    one = packing.wrap_passthrough(free)
    none = F.lit(None).cast("string")
    return one.select("sub_piece_cid", "raw_size", "status", none.alias("car_path"), "url", none.alias("sha256")), one.select("sub_piece_cid", "member_cid", F.lit(0).cast("long").alias("member_sort_order"), "raw_size", none.alias("sha256"))


def aggregate_free(state: State, version: int, new: DataFrame, new_members: DataFrame, cap: int) -> Planned:
    """New aggregates over every built sub-piece, of the state or new, that is in none, in order of id; existing ones stay as they are."""
    columns = ["sub_piece_cid", "raw_size", "status"]
    built = state.table("sub_pieces", version).select(columns).union(new.select(columns)).where("status = 'built'")
    free = cut(built.join(state.table("aggregate_members", version).select("sub_piece_cid"), "sub_piece_cid", "left_anti"))
    placed = cut(packing.append_aggregates(free, state.table("aggregates", version), cap))
    order = (F.row_number().over(Window.partitionBy("idx").orderBy("sub_piece_cid")) - 1).cast("long")  # an aggregate is bounded by its budget
    members = cut(placed.where("NOT oversized").select(F.col("idx").alias("aggregate_idx"), order.alias("segment_index"), "sub_piece_cid"))
    decoded = merkle.decode_commitments(free, "sub_piece_cid").select(F.col("id").alias("sub_piece_cid"), "height", F.col("root").alias("node"))
    leaves = members.join(free.select("sub_piece_cid", "raw_size"), "sub_piece_cid").join(decoded, "sub_piece_cid")
    roots = merkle.aggregate_roots(leaves.select(F.col("aggregate_idx").alias("key"), F.col("segment_index").alias("order"), "height", "node", "raw_size", F.col("sub_piece_cid").alias("id")))
    none = F.lit(None)
    aggregates = roots.select(
        F.col("key").alias("idx"), commitment_id("padding", "height", "root").alias("root_piece_cid"), F.lit(cap).cast("long").alias("piece_size"), F.lit("planned").alias("status"),
        none.cast("string").alias("tx_hash"), none.cast("string").alias("error"), none.cast("long").alias("committed_block"),
    )
    every = state.table("sub_piece_members", version).select("sub_piece_cid", "member_cid").union(new_members.select("sub_piece_cid", "member_cid"))
    oversized = every.join(placed.where("oversized").select("sub_piece_cid"), "sub_piece_cid", "left_semi").select(F.col("member_cid").alias("cid")).distinct()
    return Planned(new, new_members, aggregates, members, oversized)


def publish(state: State, version: int, pieces: DataFrame, planned: Planned) -> int:
    """The next version: pieces with those oversized marked, and everything new."""
    marked = pieces.join(planned.oversized.withColumn("_over", F.lit(True)), "cid", "left")
    marked = marked.withColumn("status", F.when(F.col("_over") & (F.col("status") == "done"), "oversized").otherwise(F.col("status"))).drop("_over")
    return state.publish(version, replace={"pieces": marked}, append={n: getattr(planned, n) for n in ("sub_pieces", "sub_piece_members", "aggregates", "aggregate_members")})


def run_plan(state: State, version: int, attempts: DataFrame, cap: int) -> int:
    """Outcomes of attempts (cid, source, rank, event_id, ok, category, piece_cid, raw_size, url) at pending pieces recorded, done ones wrapped and aggregated.

    The first source by rank that worked counts; what only the fallback could
    fetch has no URL and fails, as does what no source could.
    """
    pending = attempts.join(state.table("pieces", version).where("status = 'pending'").select("cid"), "cid", "left_semi")
    first = record_outcome(first_success(pending.withColumnRenamed("cid", "id")), "fallback")
    good = pending.where("ok").groupBy(F.col("cid").alias("id")).agg(F.min_by(F.struct("piece_cid", "raw_size", "source", "url"), F.struct("rank", "event_id")).alias("got"))
    found = first.join(good, "id", "left").select(F.col("id").alias("cid"), F.col("status").alias("_status"), F.col("failure_category").alias("_category"), "got")
    done = F.col("_status") == "done"
    sets = {n: F.when(done, F.col(f"got.{g}")).otherwise(F.col(n)) for n, g in (("piece_cid", "piece_cid"), ("raw_size", "raw_size"), ("gateway", "source"), ("url", "url"))}
    j = state.table("pieces", version).join(found, "cid", "left")
    pieces = cut(j.withColumns(sets | {"status": F.coalesce("_status", "status"), "failure_category": F.when(F.col("_status") == "failed", F.col("_category")).otherwise(F.col("failure_category")), "error": F.when(done, F.lit(None)).otherwise(F.col("error"))}).drop("_status", "_category", "got"))
    new, members = (cut(x) for x in wrap(pieces, state.table("sub_piece_members", version)))
    return publish(state, version, pieces, aggregate_free(state, version, new, members, cap))


def run_pack(state: State, version: int, payloads: DataFrame, target: int, cap: int, path: str) -> tuple[int, DataFrame]:
    """(next version, (cid) of members that failed): free pieces packed into containers at path, each a sub-piece with its commitment; payloads are (cid, payload, digest_hex).

    A bin of which a member is empty, missing or of another digest isn't built,
    and its members stay as they are. Pieces above the target become sub-pieces
    of their own where they have a URL. Ids that come twice are refused.
    """
    if target > RAW_LIMIT:
        raise Refused(f"target {target} is above the limit of {RAW_LIMIT}")
    free = cut(joins.free_pieces(state.table("pieces", version), state.table("sub_piece_members", version)).withColumn("of", F.lit("all")))
    packing.assert_unique(free, "cid")
    bins = cut(packing.pack_ffd(free.select("of", "cid", F.coalesce("raw_size", F.lit(0)).cast("long").alias("raw_size")), target, "of", "cid"))
    held = bins.join(payloads, "cid", "left")
    good = F.coalesce((F.sha2("payload", 256) == F.col("digest_hex")) & (F.octet_length("payload") > 0), F.lit(False))
    sound = cut(held.groupBy("bin").agg(F.bool_and(good).alias("sound")))
    failed = bins.join(sound.where("NOT sound"), "bin", "left_semi").select("cid")
    build = bins.join(sound.where("sound"), "bin", "left_semi").select(F.col("of").alias("group"), "bin", F.col("cid").alias("id"))
    plan = cut(packing.assemble_plan(build, payloads.select(F.col("cid").alias("id"), F.col("cid").alias("digest_hex"), F.octet_length("payload").cast("long").alias("raw_size"))))
    index = cut(containers.write_containers(plan, payloads.select(F.col("cid").alias("id"), "payload"), path))
    files = tables.read_objects(state.spark, f"{path}/*.bin").select(F.regexp_extract("path", "([^/]*)$", 1).alias("id"), "payload", "digest_hex")
    committed = merkle.commit_objects(files.select("id", "payload")).join(files.select("id", "digest_hex"), "id")
    named = cut(committed.select(F.col("id").alias("container"), "raw_size", "digest_hex", commitment_id("padding", "height", "root").alias("sub_piece_cid")))
    none = F.lit(None).cast("string")
    built = named.select("sub_piece_cid", "raw_size", F.lit("built").alias("status"), F.concat(F.lit(f"{path}/"), "container").alias("car_path"), none.alias("url"), F.col("digest_hex").alias("sha256"))
    place = (F.row_number().over(Window.partitionBy("container").orderBy("offset", "id")) - 1).cast("long")
    members = index.join(named.select("container", "sub_piece_cid"), "container").select("sub_piece_cid", F.col("id").alias("member_cid"), place.alias("member_sort_order"), F.col("size").alias("raw_size"), "sha256")
    large, large_members = wrap(free.where(F.col("raw_size") > target), members.select("member_cid"))
    new, all_members = cut(built.unionByName(large)), cut(members.unionByName(large_members))
    return publish(state, version, state.table("pieces", version), aggregate_free(state, version, new, all_members, cap)), failed


def import_manifest(state: State, version: int, header: DataFrame, rows: DataFrame, network: str, cap: int) -> int:
    """A manifest (its header, and place, cid, piece_cid, raw_size, url) recorded, wrapped and aggregated; any broken rule, another network or any conflict refuses it whole."""
    problems = cut(intake.manifest_problems(header, rows))
    refuse(problems.select(F.concat(F.when(F.col("place").isNull(), "").otherwise(F.concat(F.lit("pieces["), "place", F.lit("] "))), "field", F.lit(": "), "problem").alias("message")), "the manifest breaks rules")
    top = header.first()
    if top["network"] != network:
        raise Refused(f"the manifest is for {top['network']}, not {network}")
    known, sub = state.table("pieces", version), state.table("sub_pieces", version)
    plan = cut(joins.import_plan(rows.select("cid", "piece_cid", "raw_size"), known, sub))
    refuse(plan.where("plan = 'conflict'").select(F.concat("cid", F.lit(": "), "reason").alias("message")), "the manifest conflicts with the state")
    pieces = cut(joins.apply_import(rows.select("cid", "piece_cid", "raw_size"), known, sub, top["gateway"]))
    new, members = (cut(x) for x in wrap(pieces, state.table("sub_piece_members", version)))
    return publish(state, version, pieces, aggregate_free(state, version, new, members, cap))


# --- queries ---------------------------------------------------------------------------------------------------------


def committed_pieces(spark, d) -> DataFrame:
    """The pieces with ids and commitments in their canonical spelling; the digest stands for the root."""
    p = fx.pieces(spark, d).withColumn("digest", F.substring("cid", 10, 64))
    height = F.lpad(F.lower(F.hex(merkle.c.tree_height(F.col("raw_size")))), 2, "0")
    named = p.withColumn("cid", intake.canonical_id(F.concat(F.lit("f01551220"), "digest"))).withColumn("piece_cid", intake.canonical_id(F.concat(F.lit("f015591202200"), height, "digest")))
    return cut(named.withColumn("error", F.lit(None).cast("string")))


_TOP = merkle.TOP_SQL
#: The same in SQL, with the height of each tree.
COMMITTED_SQL = f"""cp AS MATERIALIZED (SELECT k, raw_size, status, failure_category, gateway, url, digest, height, {fx.base32_sql("'01551220' || t.digest", 58)} AS cid, {fx.base32_sql("'015591202200' || printf('%02x', t.height) || t.digest", 63)} AS piece_cid
    FROM (SELECT k, raw_size, status, failure_category, gateway, url, cid[10:] AS digest, {_TOP} AS height FROM pieces) AS t)"""


def aggregated_sql(free: str, cap: int) -> str:
    """CTEs that pack a CTE (id, raw_size, height, node in hex) in order of id: ag (id, idx, segment), ovr (id) and made (idx, root_piece_cid)."""
    return f"""fo AS MATERIALIZED (SELECT id, 32::BIGINT << height AS padded, row_number() OVER (ORDER BY id) AS i FROM {free} WHERE 32::BIGINT << height <= {cap}),
    nf AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS bin, NULL::VARCHAR AS id UNION ALL SELECT o.i, CASE WHEN used + padded > {cap} THEN padded ELSE used + padded END, CASE WHEN used + padded > {cap} THEN bin + 1 ELSE bin END, o.id FROM nf JOIN fo AS o ON o.i = nf.i + 1),
    ag AS MATERIALIZED (SELECT id, bin AS idx, row_number() OVER (PARTITION BY bin ORDER BY id) - 1 AS segment FROM nf WHERE i > 0), ovr AS (SELECT id FROM {free} WHERE 32::BIGINT << height > {cap}),
    am AS (SELECT idx AS key, segment AS o, raw_size, height, node FROM ag JOIN {free} USING (id)), ats AS (SELECT key, sum(1::BIGINT << height)::BIGINT AS total, max(height) AS most, sum(raw_size) AS raw_size FROM am GROUP BY key),
    al AS (SELECT am.key, height, coalesce(sum(1::BIGINT << height) OVER (PARTITION BY am.key ORDER BY height DESC, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT >> height AS pos, node, CASE WHEN total = 1 THEN most ELSE greatest(most, length(bin(total - 1))) END AS top FROM am JOIN ats USING (key)),
    {merkle_sql("al", "key", 20)},
    mr AS (SELECT key AS idx, root, {_TOP} AS h, (32::BIGINT << ({_TOP})) // 128 * 127 - raw_size AS n FROM ats JOIN roots USING (key)), mb AS (SELECT idx, {merkle.VARINT_SQL} || printf('%02x', h) || root AS body FROM mr), mx AS (SELECT idx, '01559120' || printf('%02x', length(body) // 2) || body AS hx FROM mb),
    made AS (SELECT idx, CASE length(hx) WHEN 78 THEN {fx.base32_sql("mx.hx", 63)} WHEN 80 THEN {fx.base32_sql("mx.hx", 64)} ELSE {fx.base32_sql("mx.hx", 66)} END AS root_piece_cid FROM mx)"""


def _planned(state: State, version: int) -> DataFrame:
    """Every piece with its status, and the aggregate that holds it."""
    where = state.table("sub_piece_members", version).join(state.table("aggregate_members", version), "sub_piece_cid")
    where = where.join(state.table("aggregates", version), F.col("aggregate_idx") == F.col("idx")).select(F.col("member_cid").alias("cid"), "idx", "segment_index", "member_sort_order", "root_piece_cid")
    return state.table("pieces", version).join(where, "cid", "left").select("cid", "status", "failure_category", "url", "idx", "segment_index", "member_sort_order", "root_piece_cid")


_OUT = "idx, segment AS segment_index, CASE WHEN idx IS NOT NULL THEN 0 END AS member_sort_order, root_piece_cid"


@query("job1_plan_aggregates", f"""RECURSIVE {COMMITTED_SQL}, st AS (SELECT cid, piece_cid AS id, raw_size, height, digest AS node, CASE WHEN k % 7 = 6 OR k % 7 = 3 THEN 'failed' ELSE 'done' END AS s, CASE WHEN k % 7 = 6 THEN 'unservable_fallback_only' WHEN k % 7 = 3 THEN 'source_gateway_429' END AS failure_category, CASE WHEN k % 7 IN (1, 4) THEN 'https://b/' || cid WHEN k % 7 NOT IN (3, 6) THEN 'https://a/' || cid END AS url FROM cp),
    fr AS (SELECT * FROM st WHERE s = 'done'), {aggregated_sql("fr", 16384)} SELECT cid, CASE WHEN id IN (SELECT id FROM ovr) AND s = 'done' THEN 'oversized' ELSE s END AS status, failure_category, url, {_OUT} FROM st LEFT JOIN ag USING (id) LEFT JOIN made USING (idx)""")
def job1_plan_aggregates(spark, d):
    """Pending pieces with attempts at two sources and a fallback, planned: every piece, its outcome and its place in an aggregate."""
    p, k = committed_pieces(spark, d), F.col("k")
    state = State(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}")
    fresh = {n: F.lit(None).cast("string") for n in ("piece_cid", "gateway", "url", "failure_category")}
    state.publish(0, replace={"pieces": p.withColumns(fresh | {"raw_size": F.lit(None).cast("long"), "status": F.lit("pending")})})
    url = lambda host: F.concat(F.lit(f"https://{host}/"), "cid")
    tries = [("a", 0, k % 7 != 6, ~(k % 7).isin(1, 3, 4), url("a")), ("b", 1, k % 7 != 2, (k % 7).isin(1, 4, 5), url("b")), ("fallback", 2, k % 7 == 6, F.lit(True), F.lit(None).cast("string"))]
    attempts = None
    for source, rank, made, ok, at in tries:
        category = F.when(~ok, F.lit("other" if source == "a" else "source_gateway_429"))
        one = p.where(made).select("cid", F.lit(source).alias("source"), F.lit(rank).alias("rank"), k.alias("event_id"), ok.alias("ok"), category.alias("category"), "piece_cid", "raw_size", at.alias("url"))
        attempts = one if attempts is None else attempts.union(one)
    return _planned(state, run_plan(state, 1, attempts, 16384))


_PACK = 20000


@query("job2_pack_sub_pieces", f"""RECURSIVE {COMMITTED_SQL}, tx AS MATERIALIZED (SELECT sha256(text) AS digest, any_value(lower(hex(encode(text)))) AS h FROM documents GROUP BY 1), fp AS MATERIALIZED (SELECT cid, digest, raw_size, k, url, piece_cid, height FROM cp WHERE status = 'done'),
    o AS MATERIALIZED (SELECT cid, raw_size, row_number() OVER (ORDER BY raw_size DESC, cid) AS i FROM fp WHERE raw_size <= {_PACK}),
    ff AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS free, NULL::VARCHAR AS cid, 0::BIGINT AS bin UNION ALL SELECT i, CASE WHEN p > len(free) THEN list_append(free, {_PACK} - raw_size) ELSE list_concat(list_append(free[:p - 1], free[p] - raw_size), free[p + 1:]) END, cid, p - 1
        FROM (SELECT o.i, ff.free, o.cid, o.raw_size, coalesce(list_position(list_transform(ff.free, lambda x: x >= o.raw_size), true), len(ff.free) + 1) AS p FROM ff JOIN o ON o.i = ff.i + 1)),
    bm AS (SELECT bin, cid, digest, raw_size, k FROM ff JOIN fp USING (cid) WHERE i > 0), bad AS (SELECT DISTINCT bin FROM bm WHERE k % 40 = 5 OR raw_size = 0), gm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY cid) - 1 AS mo FROM bm WHERE bin NOT IN (SELECT bin FROM bad)),
    jo AS MATERIALIZED (SELECT bin, sum(raw_size)::BIGINT AS raw_size, string_agg(h, '' ORDER BY cid) AS h FROM gm JOIN tx USING (digest) GROUP BY bin), {merkle.leaves_sql(f"SELECT bin AS id, h, raw_size, {_TOP} AS top FROM jo")}, {merkle_sql("leaves", "id", 16, "c")},
    bx AS (SELECT id AS bin, top AS h, (32::BIGINT << top) // 128 * 127 - raw_size AS n, root, raw_size FROM raw JOIN croots USING (id)), bw AS (SELECT *, {merkle.VARINT_SQL} || printf('%02x', h) || root AS body FROM bx), bz AS (SELECT *, '01559120' || printf('%02x', length(body) // 2) || body AS hx FROM bw),
    sp AS MATERIALIZED (SELECT bin, CASE length(hx) WHEN 78 THEN {fx.base32_sql("bz.hx", 63)} WHEN 80 THEN {fx.base32_sql("bz.hx", 64)} ELSE {fx.base32_sql("bz.hx", 66)} END AS id, raw_size, h AS height, root AS node FROM bz),
    pt AS (SELECT cid, piece_cid AS id, raw_size, height, digest AS node FROM fp WHERE raw_size > {_PACK} AND url IS NOT NULL), fr AS MATERIALIZED (SELECT id, raw_size, height, node FROM sp UNION ALL SELECT id, raw_size, height, node FROM pt), {aggregated_sql("fr", 65536)},
    hm AS (SELECT cid, id, mo FROM gm JOIN sp USING (bin) UNION ALL SELECT cid, id, 0 FROM pt)
    SELECT cid, CASE WHEN hm.id IN (SELECT id FROM ovr) THEN 'oversized' ELSE status END AS status, failure_category, url, idx, segment AS segment_index, CASE WHEN idx IS NOT NULL THEN mo END AS member_sort_order, root_piece_cid FROM cp LEFT JOIN hm USING (cid) LEFT JOIN ag ON hm.id = ag.id LEFT JOIN made USING (idx)""")
def job2_pack_sub_pieces(spark, d):
    """Done pieces packed into containers, some with other bytes than their digest says: every piece, its sub-piece's place in an aggregate, and that aggregate's commitment."""
    p = committed_pieces(spark, d)
    state = State(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}")
    state.publish(0, replace={"pieces": p})
    bytes_of = fx.objects(spark, d).groupBy("digest_hex").agg(F.first("payload").alias("payload"))
    payloads = cut(p.join(bytes_of, F.col("digest") == F.col("digest_hex")).select("cid", F.when(F.col("k") % 40 == 5, F.concat("payload", F.lit(b"!"))).otherwise(F.col("payload")).alias("payload"), "digest_hex"))
    version, _ = run_pack(state, 1, payloads, _PACK, 65536, f"{shared_dir(spark)}/containers-{uuid.uuid4().hex}")
    return _planned(state, version)


@query("job6_import_export", f"""RECURSIVE {COMMITTED_SQL}, st AS (SELECT cid, piece_cid AS id, raw_size, height, digest AS node, CASE WHEN k % 2 = 0 AND status = 'oversized' THEN status ELSE 'done' END AS s, CASE WHEN k % 2 = 0 THEN failure_category END AS failure_category,
    CASE WHEN k % 2 = 0 AND status IN ('done', 'oversized') THEN url ELSE 'https://g.example/ipfs/' || cid || '?format=car&dag-scope=all&car-version=1&car-order=dfs&car-dups=n' END AS url FROM cp WHERE url IS NOT NULL AND raw_size > 0),
    fr AS (SELECT * FROM st WHERE s = 'done'), {aggregated_sql("fr", 32768)} SELECT cid, CASE WHEN id IN (SELECT id FROM ovr) AND s = 'done' THEN 'oversized' ELSE s END AS status, failure_category, url, {_OUT} FROM st LEFT JOIN ag USING (id) LEFT JOIN made USING (idx)""")
def job6(spark, d):
    """A manifest exported, read again and imported into a state that knows half of its pieces: those recorded stay, the others are recorded, wrapped and aggregated."""
    p = committed_pieces(spark, d).where("url IS NOT NULL AND raw_size > 0")
    state = State(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}")
    known = F.col("status").isin("done", "oversized")
    state.publish(0, replace={"pieces": p.where("k % 2 = 0").withColumn("piece_cid", F.when(known, F.col("piece_cid")))})
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    tables.write_manifest(p.select("cid", "piece_cid", "raw_size", "url"), path, {"network": "calibration", "gateway": "https://g.example"})
    header, rows = tables.read_manifest_lines(spark, path)
    return _planned(state, import_manifest(state, 1, header, cut(rows), "calibration", 32768))
