"""Jobs composed of operators."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import columns as c
from ..operators import aggregations as ag
from ..operators import joins as jn
from ..operators import packing
from ..operators.packing import append_aggregates, assemble_plan, pack_ffd, wrap_passthrough
from ..operators.windows import admit, stride_sample
from ..registry import query
from ..sources import containers, tables
from ..sources.state import KEYS, TABLES, Refused, StaleVersion, State, save_sub_pieces
from .primitives import cut, shared_dir


@query("job1_plan", "SELECT count(*) AS n_sub_pieces, sum(raw_size) AS bytes, count(*) FILTER (1::BIGINT << CAST(ceil(log2(greatest(128, ceil(raw_size * 128 / 127.0)))) AS INT) > 20000) AS n_oversized FROM pieces WHERE status = 'done' AND url IS NOT NULL")
def job1(spark, d):
    """Done, servable pieces wrapped and packed: totals of the plan."""
    p = fx.pieces(spark, d)
    wrapped = cut(wrap_passthrough(jn.free_pieces(p, p.limit(0).select(F.col("cid").alias("member_cid")))))
    plan = append_aggregates(wrapped.select("sub_piece_cid", "raw_size"), p.limit(0).select(F.col("k").alias("idx")), 20000)
    return plan.join(wrapped, "sub_piece_cid").agg(F.count("*").alias("n_sub_pieces"), F.sum("raw_size").alias("bytes"), F.count_if("oversized").alias("n_oversized"))


@query("job2_pack", "SELECT count(*) AS members, sum(raw_size) AS bytes FROM objects WHERE raw_size <= 20000")
def job2(spark, d):
    o = fx.objects(spark, d)
    bins = pack_ffd(o, 20000, "source").select(F.col("source").alias("group"), "bin", F.col("object_id").alias("id"))
    return assemble_plan(bins, o.select(F.col("object_id").alias("id"), "digest_hex", "raw_size")).agg(F.count("*").alias("members"), F.sum("raw_size").alias("bytes"))


_J4 = """o AS (SELECT object_id, raw_size, row_number() OVER (ORDER BY object_id) - 1 AS i, count(*) OVER () AS t FROM objects), s AS (SELECT * FROM o WHERE i IN (SELECT x * t // 100 FROM (SELECT unnest(range(100)) AS x), (SELECT any_value(t) AS t FROM o)))"""


@query("job4_analyze", f"{_J4} SELECT count(*) AS sampled, CAST(floor(avg(raw_size) * any_value(t) + 0.5) AS BIGINT) AS estimated_bytes, CASE WHEN any_value(t) <= 1000 THEN 'Laptop tester' ELSE 'SMB / small studio' END AS profile FROM s")
def job4(spark, d):
    """A stride sample, the size that it lets expect, and the profile for it."""
    o = fx.objects(spark, d).select("object_id", "raw_size")
    s = cut(stride_sample(o, ["object_id"], 100))
    one = s.agg(F.count("*").alias("sampled")).join(F.broadcast(ag.extrapolate(s, o))).join(F.broadcast(o.agg(F.count("*").alias("n"))))
    return one.select("sampled", "estimated_bytes", c.profile_name(F.col("n"), F.col("estimated_bytes"), F.lit(None).cast("long"), F.lit(None).cast("double")).alias("profile"))


def status_document(pieces: DataFrame, aggs: DataFrame) -> DataFrame:
    """One JSON document, schema version 1: counts, categories, aggregates by status, and at most 50 failures."""
    pairs = lambda df, k: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n"))))
    counts = ag.piece_counts(pieces).select(F.struct("*").alias("counts"))
    category = ag.failures_by_category(pieces).agg(pairs(None, "category").alias("failuresByCategory"))
    status = ag.aggregates_by_status(aggs).agg(pairs(None, "status").alias("aggregates"))
    failed = pieces.where("status = 'failed'").orderBy("cid").limit(50).agg(F.array_sort(F.collect_list(F.struct("cid", "failure_category"))).alias("failures"))
    one = counts.join(F.broadcast(category)).join(F.broadcast(status)).join(F.broadcast(failed))
    return one.select(F.to_json(F.struct(F.lit(1).alias("schemaVersion"), "counts", "failuresByCategory", "aggregates", "failures")).alias("document"))


@query("src5_status_document", "SELECT (SELECT count(*) FROM pieces) AS total, (SELECT count(*) FROM aggregates WHERE status = 'committed') AS committed, least(50, (SELECT count(*) FROM pieces WHERE status = 'failed')) AS failures")
def src5(spark, d):
    doc = status_document(fx.pieces(spark, d), fx.aggregates(spark, d))
    return doc.select(F.get_json_object("document", "$.counts.total").cast("long").alias("total"), F.get_json_object("document", "$.aggregates.committed").cast("long").alias("committed"), F.size(F.from_json(F.get_json_object("document", "$.failures"), "array<struct<cid:string>>")).cast("long").alias("failures"))


_PAIRS = "'{{' || coalesce((SELECT string_agg('\"' || k || '\":' || n, ',' ORDER BY k) FROM ({})), '') || '}}'"


@query("src5_status_text", f"""SELECT '{{"schemaVersion":1,"counts":{{"pending":' || count(*) FILTER (status = 'pending') || ',"processing":' || count(*) FILTER (status = 'processing') || ',"done":' || count(*) FILTER (status = 'done') || ',"failed":' || count(*) FILTER (status = 'failed') || ',"oversized":' || count(*) FILTER (status = 'oversized') || ',"total":' || count(*) || '}},"failuresByCategory":'
    || {_PAIRS.format("SELECT coalesce(failure_category, 'other') AS k, count(*) AS n FROM pieces WHERE status = 'failed' GROUP BY 1")} || ',"aggregates":' || {_PAIRS.format("SELECT status AS k, count(*) AS n FROM aggregates GROUP BY 1")}
    || ',"failures":[' || coalesce((SELECT string_agg('{{"cid":"' || cid || '"' || coalesce(',"failure_category":"' || failure_category || '"', '') || '}}', ',' ORDER BY cid) FROM (SELECT * FROM pieces WHERE status = 'failed' ORDER BY cid LIMIT 50)), '') || ']}}' AS document FROM pieces""")
def src5_text(spark, d):
    """The status document itself."""
    return status_document(fx.pieces(spark, d), fx.aggregates(spark, d))


@query("ag17_import_summary", f"{jn.IMPORT_SQL}, r AS (SELECT s.cid IS NULL AS fresh, m.piece_cid IN (SELECT piece_cid FROM u) AS taken, s.status IN ('done', 'oversized') AS rec, s.piece_cid = m.piece_cid AND s.raw_size = m.raw_size AS same FROM m LEFT JOIN s ON m.cid = s.cid) SELECT count(*) AS total, count(*) FILTER (CASE WHEN fresh THEN NOT taken ELSE NOT rec END) AS imported, count(*) FILTER (NOT fresh AND rec AND same) AS recorded, count(*) FILTER (CASE WHEN fresh THEN taken ELSE rec AND NOT same END) AS conflicts FROM r")
def ag17_import(spark, d):
    return ag.import_summary(jn.import_plan(*jn.import_fixture(spark, d)))


@query("ag17_pack_summary", packing.ASSEMBLED + ", h AS (SELECT \"group\", bin, bool_and(id % 40 <> 7) AS sound, count(*) AS n FROM asm GROUP BY 1, 2) SELECT count(*) AS bins, count(*) FILTER (sound) AS built, count(*) FILTER (NOT sound) AS failed, coalesce(sum(n) FILTER (NOT sound), 0) AS failed_members FROM h")
def ag17_pack(spark, d):
    o = fx.objects(spark, d)
    bins = pack_ffd(o, 20000, "source").select(F.col("source").alias("group"), "bin", F.col("object_id").alias("id"))
    return ag.pack_summary(bins.withColumn("sound", F.col("id") % 40 != 7))


@query("job5_status", "SELECT status, count(*) AS n, sum(raw_size) AS bytes FROM pieces GROUP BY status")
def job5(spark, d):
    return fx.pieces(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.sum("raw_size").alias("bytes"))


_DONE = "SELECT cid, piece_cid, raw_size, 'https://' || gateway || '/ipfs/' || cid || '?format=car&dag-scope=all&car-version=1&car-order=dfs&car-dups=n' AS url FROM pieces WHERE status = 'done' AND url IS NOT NULL AND gateway = 'src5'"


def _export(spark, d):
    p = fx.pieces(spark, d).where("status = 'done' AND url IS NOT NULL AND gateway = 'src5'")
    return p.select("cid", "piece_cid", "raw_size", c.canonical_url(F.concat(F.lit("https://"), "gateway"), F.col("cid")).alias("url"))


@query("src2_src3_manifest", f"SELECT *, row_number() OVER (ORDER BY cid) - 1 AS place, 'calibration' AS network, 'https://src5' AS gateway FROM ({_DONE})")
def src2(spark, d):
    """A manifest written by many tasks and scanned again."""
    path = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    out = _export(spark, d)
    ag.assert_single(out.select(F.regexp_extract("url", "^https://([^/]*)", 1).alias("source")), "source")
    tables.write_manifest(out, path, {"network": "calibration", "gateway": "https://src5"})
    head, pieces = tables.read_manifest_lines(spark, path)
    return pieces.join(F.broadcast(head.select("network", "gateway")))  # one row


def first_state(spark, d, members: DataFrame | None = None) -> State:
    """A new state folder whose version 1 has all seven tables. members: fx.aggregate_members(spark, d) where a caller has them already."""
    state = State(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}")
    none = lambda df, **kinds: df.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items() if n not in df.columns})
    key = lambda df, *names: df.withColumns({n: F.col(n).cast("string") for n in names})
    sub = key(fx.sub_pieces(spark, d), "sub_piece_cid")
    log = fx.lifecycle(spark, d).where("kind IN ('submitted', 'parked')")
    state.publish(0, replace={
        "pieces": none(fx.pieces(spark, d), error="string"),
        "aggregates": none(fx.aggregates(spark, d), root_piece_cid="string", piece_size="bigint", committed_block="bigint"),
        "aggregate_members": key(fx.aggregate_members(spark, d) if members is None else members, "sub_piece_cid"),
        "sub_pieces": none(sub, sha256="string"),
        "sub_piece_members": none(key(fx.sub_piece_members(spark, d), "sub_piece_cid", "member_cid"), raw_size="bigint", sha256="string"),
        "pull_batch_attempts": log.select(F.col("seq").alias("attempt"), F.col("key").alias("aggregate_idx"), F.lit(0).alias("batch"), F.array(F.col("kind")).alias("piece_cids"), F.col("ts").alias("started"), F.lit(None).cast("string").alias("result")),
        "grants": fx.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("grant"), F.lit("add").alias("permission"), F.col("c_custkey").alias("expires")),
    })
    return state


@query("src4_state", """SELECT 'pieces' AS name, count(*) AS n, count(DISTINCT cid) AS keys FROM pieces UNION ALL SELECT 'aggregates', count(*), count(DISTINCT idx) FROM aggregates UNION ALL SELECT 'aggregate_members', count(*), count(DISTINCT (aggregate_idx, segment_index)) FROM aggregate_members UNION ALL SELECT 'sub_pieces', count(*), count(DISTINCT sub_piece_cid) FROM sub_pieces
    UNION ALL SELECT 'sub_piece_members', count(*), count(DISTINCT (sub_piece_cid, member_cid)) FROM sub_piece_members UNION ALL SELECT 'pull_batch_attempts', count(*), count(DISTINCT seq) FROM lifecycle WHERE kind IN ('submitted', 'parked') UNION ALL SELECT 'grants', count(*), count(DISTINCT c_custkey) FROM customer""")
def src4(spark, d):
    """All seven tables published as a version and loaded again: rows and distinct keys of each."""
    state = first_state(spark, d)
    return reduce(DataFrame.union, [state.table(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.countDistinct(*KEYS[name]).alias("keys")) for name in TABLES]).select("name", "n", "keys")


@query("lc7_save_sub_pieces", """n AS (SELECT 'b' || digest_hex AS sub_piece_cid, 'f01551220' || digest_hex AS member_cid, k FROM (SELECT digest_hex, min(object_id) AS k FROM objects GROUP BY 1))
    SELECT sub_piece_cid, member_cid, 2 AS version FROM n WHERE k % 2 = 0 UNION ALL SELECT sub_piece_cid, member_cid, 3 FROM n WHERE k % 2 = 1""")
def lc7_save(spark, d):
    """Two saves of new sub-pieces with their members; between them three that are refused: unknown members, known keys, and a version that is no longer the last."""
    state = State(spark, f"{shared_dir(spark)}/state-{uuid.uuid4().hex}")
    p = cut(fx.pieces(spark, d).withColumns({"error": F.lit(None).cast("string"), "sub_piece_cid": F.concat(F.lit("b"), F.substring("cid", 10, 64))}))
    state.publish(0, replace={"pieces": p})
    sub = lambda rows: rows.select("sub_piece_cid", "raw_size", F.lit("built").alias("status"), F.concat(F.lit("/c/"), "k").alias("car_path"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("sha256"))
    held = lambda rows: rows.select("sub_piece_cid", F.col("cid").alias("member_cid"), F.lit(0).alias("member_sort_order"), "raw_size", F.lit(None).cast("string").alias("sha256"))
    even, odd = p.where("k % 2 = 0"), p.where("k % 2 = 1")
    save_sub_pieces(state, 1, sub(even), held(even))
    for expected, rows, members in [(2, odd, held(odd).withColumn("member_cid", F.lit("other"))), (2, even, held(even)), (1, odd, held(odd))]:
        try:
            save_sub_pieces(state, expected, sub(rows), members)
        except (Refused, StaleVersion):
            continue
        raise AssertionError("a save that should be refused was published")
    save_sub_pieces(state, 2, sub(odd), held(odd))
    versions = [state.table("sub_piece_members", v).select("sub_piece_cid", "member_cid") for v in (2, 3)]
    return versions[1].join(versions[0].withColumn("version", F.lit(2)), ["sub_piece_cid", "member_cid"], "left").select("sub_piece_cid", "member_cid", F.coalesce("version", F.lit(3)).alias("version"))


@query("src6_export_remainder", "SELECT cid, raw_size FROM pieces WHERE k % 10 = 3")
def src6(spark, d):
    """The rows of a manifest that were too small or deferred."""
    p = fx.pieces(spark, d)
    return p.join(p.where("k % 10 = 3").select("cid"), "cid", "left_semi").select("cid", "raw_size")


def _contained(spark, d) -> tuple[DataFrame, str]:
    """The index of containers written for every source, and their folder."""
    path = f"{shared_dir(spark)}/containers-{uuid.uuid4().hex}"
    o = fx.objects(spark, d)
    bins = pack_ffd(o, 20000, "source").select(F.col("source").alias("group"), "bin", F.col("object_id").alias("id"))
    plan = assemble_plan(bins, o.select(F.col("object_id").alias("id"), "digest_hex", "raw_size"))
    return containers.write_containers(plan, o.select(F.col("object_id").alias("id"), "payload"), path), path


@query("src7_write_containers", packing.ASSEMBLED + " SELECT \"group\", bin, CAST(id AS VARCHAR) AS id, \"offset\", raw_size AS size, digest_hex AS sha256, digest_hex AS read_back FROM asm")
def src7(spark, d):
    """Containers written by the data source; every member read back at its offset, with its digest as written and as read."""
    index, path = _contained(spark, d)
    return containers.read_members(index, path).select("group", "bin", "id", "offset", "size", "sha256", F.sha2("payload", 256).alias("read_back"))


@query("src8_read_objects", packing.ASSEMBLED + ", t AS (SELECT doc_id, lower(hex(encode(text))) AS h FROM documents) SELECT \"group\" || '-' || bin || '.bin' AS name, sum(raw_size) AS raw_size, sha256(unhex(string_agg(h, '' ORDER BY \"offset\", id))) AS digest_hex FROM asm JOIN t ON doc_id = id GROUP BY \"group\", bin")
def src8(spark, d):
    """The containers read as binary files: their size and the digest of their bytes."""
    _, path = _contained(spark, d)
    return tables.read_objects(spark, f"{path}/*.bin").select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "raw_size", "digest_hex")


@query("job7_advance", """r AS (SELECT idx, status, tx_hash IS NOT NULL AS t, root IS NOT NULL AS o, coalesce(list_contains(roots, idx), false) AS l FROM aggregates LEFT JOIN ledger ON idx = root LEFT JOIN added_events ON tx = tx_hash WHERE status <> 'committed' AND status <> 'planned')
    SELECT CASE WHEN t THEN CASE WHEN NOT o THEN 'wait' WHEN l THEN 'commit' ELSE 'commit_unverified' END WHEN status = 'add_unconfirmed' THEN CASE WHEN o THEN 'commit' ELSE 'hold' END WHEN o THEN 'already_on_ledger' ELSE 'proceed' END AS decision, count(*) AS n FROM r GROUP BY 1""")
def job7(spark, d):
    """Decisions for what is admitted when no slot is free: rows in flight only."""
    a = fx.aggregates(spark, d)
    go = admit(a, 1, fx.fees(spark, d))
    return jn.resume_decision(a.join(go.select("idx"), "idx", "left_semi"), fx.ledger(spark, d), fx.added_events(spark, d)).groupBy("decision").agg(F.count("*").alias("n"))


@query("job8_verify", "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN root IS NULL THEN 'missing' WHEN idx IS NULL THEN 'unrecognized' ELSE 'found' END AS verdict FROM aggregates FULL JOIN ledger ON idx = root) GROUP BY 1")
def job8(spark, d):
    return jn.verify_set(fx.aggregates(spark, d).select(F.col("idx").alias("key")), fx.ledger(spark, d).select(F.col("root").alias("key"))).groupBy("verdict").agg(F.count("*").alias("n"))
