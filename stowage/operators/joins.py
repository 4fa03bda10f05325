"""Joins of inventory state with itself and with the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import columns as c
from ..registry import query
from .rows import resumable


def register(state: DataFrame, ids: DataFrame) -> DataFrame:
    """state with a pending row for each new id; existing rows stay as they are."""
    new = ids.select("cid").distinct().join(state.select("cid"), "cid", "left_anti")
    return state.unionByName(new.withColumn("status", F.lit("pending")), allowMissingColumns=True)


@query("jn1_register", "SELECT cid, status FROM pieces WHERE k % 2 = 0 UNION ALL SELECT cid, 'pending' FROM pieces WHERE k % 2 = 1")
def jn1(spark, d):
    p = fx.pieces(spark, d)
    return register(p.where("k % 2 = 0").select("cid", "status"), fx.objects(spark, d).select(F.concat(F.lit("f01551220"), "digest_hex").alias("cid")))


def free_pieces(pieces: DataFrame, members: DataFrame) -> DataFrame:
    return pieces.where("status = 'done'").join(members.select(F.col("member_cid").alias("cid")).distinct(), "cid", "left_anti")


@query("jn2_free_pieces", "SELECT cid, raw_size FROM pieces WHERE status = 'done' AND NOT (k % 3 = 0)")
def jn2(spark, d):
    p = fx.pieces(spark, d)
    return free_pieces(p, p.where("k % 3 = 0").select(F.col("cid").alias("member_cid"))).select("cid", "raw_size")


def free_sub_pieces(sub: DataFrame, members: DataFrame) -> DataFrame:
    return sub.where("status = 'built'").join(members.select("sub_piece_cid").distinct(), "sub_piece_cid", "left_anti")


@query("jn3_free_sub_pieces", "SELECT sub_piece_cid FROM sub_pieces WHERE status = 'built' AND sub_piece_cid NOT IN (SELECT sub_piece_cid FROM aggregate_members WHERE aggregate_idx % 10 = 0)")
def jn3(spark, d):
    return free_sub_pieces(fx.sub_pieces(spark, d), fx.aggregate_members(spark, d).where("aggregate_idx % 10 = 0")).select("sub_piece_cid")


def locked_members(aggs: DataFrame, members: DataFrame, sub_members: DataFrame) -> DataFrame:
    """Source ids in an aggregate past planned."""
    past = aggs.where("status <> 'planned'").select(F.col("idx").alias("aggregate_idx"))
    subs = members.join(past, "aggregate_idx", "left_semi").select("sub_piece_cid").distinct()
    return sub_members.join(subs, "sub_piece_cid", "left_semi").select("member_cid").distinct()


@query("jn4_locked_members", "SELECT DISTINCT member_cid FROM sub_piece_members WHERE sub_piece_cid IN (SELECT sub_piece_cid FROM aggregate_members JOIN aggregates ON aggregate_idx = idx WHERE status <> 'planned')")
def jn4(spark, d):
    return locked_members(fx.aggregates(spark, d), fx.aggregate_members(spark, d), fx.sub_piece_members(spark, d))


def numbered_members(sub_members: DataFrame) -> DataFrame:
    """(sub_piece_cid, nth, member_cid): source ids of each sub-piece, 0-based in member order."""
    w = Window.partitionBy("sub_piece_cid").orderBy("member_sort_order", "member_cid")
    return sub_members.select("sub_piece_cid", (F.row_number().over(w) - 1).cast("long").alias("nth"), "member_cid")


def sized_segments(members: DataFrame, sub_members: DataFrame) -> DataFrame:
    """(aggregate_idx, segment_index, sub_piece_cid, n): segments of members with the number of their source ids, without those that have none."""
    sizes = sub_members.groupBy("sub_piece_cid").agg(F.count("*").alias("n"))
    return members.select("aggregate_idx", "segment_index", "sub_piece_cid").join(sizes, "sub_piece_cid").select("aggregate_idx", "segment_index", "sub_piece_cid", "n")


def aggregate_assets(members: DataFrame, sub_members: DataFrame) -> DataFrame:
    """(aggregate_idx, place, member_cid): source ids in segment order, then member order.

    A segment's first place is the sum of the sizes before it, so only segments
    travel by aggregate; they are spelled out in the last join.
    """
    w = Window.partitionBy("aggregate_idx").orderBy("segment_index", "sub_piece_cid").rowsBetween(Window.unboundedPreceding, -1)
    begun = sized_segments(members, sub_members).select("aggregate_idx", "sub_piece_cid", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    return begun.join(numbered_members(sub_members), "sub_piece_cid").select("aggregate_idx", (F.col("first") + F.col("nth")).alias("place"), "member_cid")


@query("jn5_aggregate_assets", "SELECT aggregate_idx, row_number() OVER (PARTITION BY aggregate_idx ORDER BY segment_index, member_sort_order) - 1 AS place, member_cid FROM aggregate_members JOIN sub_piece_members USING (sub_piece_cid)")
def jn5(spark, d):
    return aggregate_assets(fx.aggregate_members(spark, d), fx.sub_piece_members(spark, d))


def aggregate_manifest(members: DataFrame, sub: DataFrame) -> DataFrame:
    return members.join(sub, "sub_piece_cid").select("aggregate_idx", "segment_index", "sub_piece_cid", F.coalesce("url", F.lit("")).alias("url"), "raw_size")


@query("jn6_aggregate_manifest", "SELECT aggregate_idx, segment_index, sub_piece_cid, coalesce(url, '') AS url, raw_size FROM aggregate_members JOIN sub_pieces USING (sub_piece_cid)")
def jn6(spark, d):
    return aggregate_manifest(fx.aggregate_members(spark, d), fx.sub_pieces(spark, d))


def evictable(aggs: DataFrame, members: DataFrame, sub: DataFrame) -> DataFrame:
    committed = members.join(aggs.where("status = 'committed'").select(F.col("idx").alias("aggregate_idx")), "aggregate_idx", "left_semi").select("sub_piece_cid").distinct()
    return sub.where(F.coalesce("car_path", F.lit("")) != "").join(committed, "sub_piece_cid", "left_semi").select("car_path")


@query("jn7_evictable", "SELECT car_path FROM sub_pieces WHERE car_path IS NOT NULL AND car_path <> '' AND sub_piece_cid IN (SELECT sub_piece_cid FROM aggregate_members JOIN aggregates ON aggregate_idx = idx WHERE status = 'committed')")
def jn7(spark, d):
    return evictable(fx.aggregates(spark, d), fx.aggregate_members(spark, d), fx.sub_pieces(spark, d))


def reconcile(aggs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each aggregate with on_ledger and its mismatch: committed but absent, or present but not committed."""
    marked = aggs.join(ledger.select(F.col("root").alias("idx"), F.lit(True).alias("on_ledger")).distinct(), "idx", "left").withColumn("on_ledger", F.coalesce("on_ledger", F.lit(False)))
    committed = F.col("status") == "committed"
    return marked.withColumn("mismatch", F.when(committed & ~F.col("on_ledger"), "committed_not_on_ledger").when(~committed & F.col("on_ledger"), "on_ledger_not_committed"))


_RECONCILE = "r AS (SELECT a.*, l.root IS NOT NULL AS on_ledger FROM aggregates a LEFT JOIN ledger l ON a.idx = l.root)"


@query("jn8_reconcile", f"{_RECONCILE} SELECT idx, status, on_ledger, CASE WHEN status = 'committed' AND NOT on_ledger THEN 'committed_not_on_ledger' WHEN status <> 'committed' AND on_ledger THEN 'on_ledger_not_committed' END AS mismatch FROM r")
def jn8(spark, d):
    return reconcile(fx.aggregates(spark, d), fx.ledger(spark, d)).select("idx", "status", "on_ledger", "mismatch")


def unaccounted_on_ledger(ledger: DataFrame, aggs: DataFrame) -> DataFrame:
    return ledger.join(aggs.select(F.col("idx").alias("root")), "root", "left_anti")


@query("jn9_unaccounted", "SELECT root FROM ledger WHERE root NOT IN (SELECT idx FROM aggregates)")
def jn9(spark, d):
    return unaccounted_on_ledger(fx.ledger(spark, d), fx.aggregates(spark, d))


def verify_set(prepared: DataFrame, active: DataFrame) -> DataFrame:
    """(key, verdict): found, missing or unrecognized."""
    a, b = prepared.select(F.col("key").alias("a")).distinct(), active.select(F.col("key").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("key"), F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unrecognized").otherwise("found").alias("verdict"))


@query("jn10_verify_set", "SELECT coalesce(idx, root) AS key, CASE WHEN root IS NULL THEN 'missing' WHEN idx IS NULL THEN 'unrecognized' ELSE 'found' END AS verdict FROM aggregates FULL JOIN ledger ON idx = root")
def jn10(spark, d):
    return verify_set(fx.aggregates(spark, d).select(F.col("idx").alias("key")), fx.ledger(spark, d).select(F.col("root").alias("key")))


def settle_deferred(deferred: DataFrame, found: DataFrame) -> DataFrame:
    """(ctx, piece, settled): deferred pieces that the ledger has are settled."""
    return deferred.join(found.select("piece", F.lit(True).alias("s")).distinct(), "piece", "left").select("ctx", "piece", F.coalesce("s", F.lit(False)).alias("settled"))


@query("jn11_settle_deferred", "x AS (SELECT DISTINCT ctx, unnest(piece_ids) AS piece FROM chunks WHERE NOT committed), f AS (SELECT DISTINCT unnest(piece_ids) AS piece FROM chunks WHERE committed) SELECT ctx, piece, piece IN (SELECT piece FROM f) AS settled FROM x")
def jn11(spark, d):
    c = fx.chunks(spark, d).select("ctx", "committed", F.explode("piece_ids").alias("piece"))
    return settle_deferred(c.where("NOT committed").select("ctx", "piece").distinct(), c.where("committed").select("piece"))


def confirm_events(aggs: DataFrame, events: DataFrame) -> DataFrame:
    """(idx, piece_id, outcome) of rows with a transaction: committed where its event lists the root, else by what is missing."""
    j = aggs.where("tx_hash IS NOT NULL").join(events, F.col("tx_hash") == F.col("tx"), "left")
    at = F.array_position("roots", F.col("idx"))
    return j.select("idx", F.when(at > 0, F.element_at("piece_ids", F.greatest(at, F.lit(1)).cast("int"))).alias("piece_id"), F.when(F.col("tx").isNull(), "committed_unverified").when(at > 0, "committed").otherwise("root_mismatch").alias("outcome"))


@query("jn12_confirm_events", "SELECT idx, CASE WHEN list_position(roots, idx) > 0 THEN piece_ids[list_position(roots, idx)] END AS piece_id, CASE WHEN tx IS NULL THEN 'committed_unverified' WHEN list_position(roots, idx) > 0 THEN 'committed' ELSE 'root_mismatch' END AS outcome FROM aggregates LEFT JOIN added_events ON tx_hash = tx WHERE tx_hash IS NOT NULL")
def jn12(spark, d):
    return confirm_events(fx.aggregates(spark, d), fx.added_events(spark, d))


def resume_decision(aggs: DataFrame, ledger: DataFrame, events: DataFrame) -> DataFrame:
    """What to do with each resumable aggregate; one that may have been added is never added again."""
    r = resumable(aggs).join(ledger.select(F.col("root").alias("idx"), F.lit(True).alias("on")).distinct(), "idx", "left").join(events.select(F.col("tx").alias("tx_hash"), "roots"), "tx_hash", "left")
    on = F.coalesce("on", F.lit(False))
    tx = F.col("tx_hash").isNotNull()
    listed = F.coalesce(F.array_contains("roots", F.col("idx")), F.lit(False))
    return r.select("idx", F.when(tx & on & listed, "commit").when(tx & on, "commit_unverified").when(tx, "wait").when((F.col("status") == "add_unconfirmed") & on, "commit").when(F.col("status") == "add_unconfirmed", "hold").when(on, "already_on_ledger").otherwise("proceed").alias("decision"))


@query("jn13_resume_decision", """r AS (SELECT idx, status, tx_hash IS NOT NULL AS t, root IS NOT NULL AS o, coalesce(list_contains(roots, idx), false) AS l FROM aggregates LEFT JOIN ledger ON idx = root LEFT JOIN added_events ON tx = tx_hash WHERE status <> 'committed')
    SELECT idx, CASE WHEN t THEN CASE WHEN NOT o THEN 'wait' WHEN l THEN 'commit' ELSE 'commit_unverified' END WHEN status = 'add_unconfirmed' THEN CASE WHEN o THEN 'commit' ELSE 'hold' END WHEN o THEN 'already_on_ledger' ELSE 'proceed' END AS decision FROM r""")
def jn13(spark, d):
    return resume_decision(fx.aggregates(spark, d), fx.ledger(spark, d), fx.added_events(spark, d))


def latest_add_epoch(aggs: DataFrame, receipts: DataFrame) -> DataFrame:
    return aggs.where("status = 'committed' AND tx_hash IS NOT NULL").join(receipts, F.col("tx_hash") == F.col("tx")).agg(F.max("block").alias("latest"))


@query("jn14_latest_add_epoch", "SELECT max(block) AS latest FROM aggregates JOIN receipts ON tx = tx_hash WHERE status = 'committed'")
def jn14(spark, d):
    return latest_add_epoch(fx.aggregates(spark, d), fx.receipts(spark, d))


def import_plan(manifest: DataFrame, state: DataFrame, sub_pieces: DataFrame) -> DataFrame:
    """(cid, plan, reason) of manifest (cid, piece_cid, raw_size) against pieces (cid, piece_cid, raw_size, status) and sub_pieces (sub_piece_cid).

    A piece that is done or oversized is recorded where commitment and size are
    the manifest's, and a conflict where either differs; any other known piece
    is an upgrade, since it has no commitment yet. An unknown piece is new,
    unless its commitment is that of a sub-piece already, which is a conflict.
    reason is null but for conflicts.
    """
    own = state.select("cid", F.lit(True).alias("known"), F.col("piece_cid").alias("old"), F.col("raw_size").alias("old_size"), F.col("status").alias("old_status"))
    taken = sub_pieces.select(F.col("sub_piece_cid").alias("piece_cid"), F.lit(True).alias("taken")).distinct()
    j = manifest.join(own, "cid", "left").join(taken, "piece_cid", "left")
    same = F.col("old").eqNullSafe(F.col("piece_cid")) & F.col("old_size").eqNullSafe(F.col("raw_size"))
    recorded = F.col("old_status").isin("done", "oversized")
    plan = (
        F.when(F.col("known").isNull(), F.when(F.col("taken"), "conflict").otherwise("new"))
        .when(F.coalesce(recorded, F.lit(False)), F.when(same, "recorded").otherwise("conflict")).otherwise("upgrade")
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    differs = F.concat(F.lit("recorded as "), text("old"), F.lit(" ("), text("old_size"), F.lit(" bytes), the manifest says "), text("piece_cid"), F.lit(" ("), text("raw_size"), F.lit(" bytes)"))
    reason = F.when(F.col("known").isNull(), F.concat(text("piece_cid"), F.lit(" is a sub-piece of another source"))).otherwise(differs)
    return j.select("cid", plan.alias("plan"), F.when(plan == "conflict", reason).alias("reason"))


#: A manifest that differs from the state in commitments, sizes and statuses, and of whose new commitments some are sub-pieces.
IMPORT_SQL = """m AS (SELECT cid, k, piece_cid || CASE WHEN k % 20 = 4 THEN 'x' ELSE '' END AS piece_cid, raw_size + CASE WHEN k % 14 = 8 THEN 1 ELSE 0 END AS raw_size FROM pieces), s AS (SELECT cid, piece_cid, raw_size, status FROM pieces WHERE k % 2 = 0),
    u AS (SELECT piece_cid FROM pieces WHERE k % 9 = 5)"""


def import_fixture(spark, d):
    p = fx.pieces(spark, d)
    k = F.col("k")
    manifest = p.select("cid", F.when(k % 20 == 4, F.concat("piece_cid", F.lit("x"))).otherwise(F.col("piece_cid")).alias("piece_cid"), (F.col("raw_size") + (k % 14 == 8).cast("long")).alias("raw_size"))
    return manifest, p.where("k % 2 = 0").select("cid", "piece_cid", "raw_size", "status", "failure_category"), p.where("k % 9 = 5").select(F.col("piece_cid").alias("sub_piece_cid"))


@query("jn15_import_plan", f"""{IMPORT_SQL}, j AS (SELECT m.*, s.cid AS known, s.piece_cid AS old, s.raw_size AS old_size, s.status, m.piece_cid IN (SELECT piece_cid FROM u) AS taken FROM m LEFT JOIN s ON m.cid = s.cid),
    p AS (SELECT *, CASE WHEN known IS NULL THEN CASE WHEN taken THEN 'conflict' ELSE 'new' END WHEN status IN ('done', 'oversized') THEN CASE WHEN old = piece_cid AND old_size = raw_size THEN 'recorded' ELSE 'conflict' END ELSE 'upgrade' END AS plan FROM j)
    SELECT cid, plan, CASE WHEN plan = 'conflict' THEN CASE WHEN known IS NULL THEN piece_cid || ' is a sub-piece of another source' ELSE 'recorded as ' || old || ' (' || old_size || ' bytes), the manifest says ' || piece_cid || ' (' || raw_size || ' bytes)' END END AS reason FROM p""")
def jn15(spark, d):
    return import_plan(*import_fixture(spark, d))


def apply_import(manifest: DataFrame, state: DataFrame, sub_pieces: DataFrame, gateway: str) -> DataFrame:
    """The pieces after an import from gateway: new and upgraded ones are done, with its URL and no error; an upgrade keeps its failure category. Any conflict leaves all as they are, and a second import changes nothing."""
    plan = import_plan(manifest, state, sub_pieces)
    refused = plan.agg(F.count_if(F.col("plan") == "conflict").alias("n_bad"))
    taken = plan.join(F.broadcast(refused)).where("n_bad = 0 AND plan IN ('new', 'upgrade')").select("cid")
    sets = {"status": F.lit("done"), "piece_cid": F.col("_piece_cid"), "raw_size": F.col("_raw_size"), "gateway": F.lit(gateway), "url": c.canonical_url(F.lit(gateway), F.col("cid")), "error": F.lit(None).cast("string")}
    take = manifest.join(taken, "cid", "left_semi").select("cid", F.col("piece_cid").alias("_piece_cid"), F.col("raw_size").alias("_raw_size"), F.lit(True).alias("_take"))
    kinds = dict(state.dtypes)
    out = state.withColumns({n: F.lit(None).cast("string") for n in ("gateway", "url", "error") if n not in kinds}).join(take, "cid", "full")
    return out.withColumns({n: F.when(F.col("_take"), v).otherwise(F.col(n)) for n, v in sets.items()}).drop("_piece_cid", "_raw_size", "_take")


@query("jn16_apply_import", """SELECT cid, piece_cid, raw_size, CASE WHEN k % 4 = 0 AND status = 'oversized' THEN status ELSE 'done' END AS status, CASE WHEN k % 4 = 0 THEN failure_category END AS failure_category,
    CASE WHEN k % 4 = 0 AND status IN ('done', 'oversized') THEN NULL ELSE 'https://g.example/ipfs/' || cid || '?format=car&dag-scope=all&car-version=1&car-order=dfs&car-dups=n' END AS url FROM pieces""")
def jn16(spark, d):
    """An import without conflicts: recorded rows stay, oversized ones too; pending and failed ones are upgraded."""
    p = fx.pieces(spark, d)
    state = p.where("k % 4 = 0").select("cid", F.when(F.col("status").isin("done", "oversized"), F.col("piece_cid")).alias("piece_cid"), "raw_size", "status", "failure_category")
    return apply_import(p.select("cid", "piece_cid", "raw_size"), state, p.limit(0).select(F.col("piece_cid").alias("sub_piece_cid")), "https://g.example").select("cid", "piece_cid", "raw_size", "status", "failure_category", "url")


@query("jn16_import_refused", f"{IMPORT_SQL} SELECT cid, piece_cid, raw_size, status, NULL::VARCHAR AS url FROM s")
def jn16_refused(spark, d):
    """Conflicts among the rows: nothing changes."""
    return apply_import(*import_fixture(spark, d), "https://g.example").select("cid", "piece_cid", "raw_size", "status", "url")


def prune_results(inputs: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(saved results that are still asked for, inputs without a result)."""
    return saved.join(inputs.select("cid"), "cid", "left_semi"), inputs.join(saved.select("cid"), "cid", "left_anti")


@query("jn17_prune_results", "SELECT cid, 'kept' AS part FROM pieces WHERE k % 2 = 0 AND k % 3 = 0 UNION ALL SELECT cid, 'pending' FROM pieces WHERE k % 2 = 0 AND k % 3 <> 0")
def jn17(spark, d):
    p = fx.pieces(spark, d).select("cid", "k")
    kept, pending = prune_results(p.where("k % 2 = 0"), p.where("k % 3 = 0"))
    return kept.select("cid", F.lit("kept").alias("part")).union(pending.select("cid", F.lit("pending")))


def verify_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("valid", F.coalesce(F.sha2("bytes", 256) == F.col("digest"), F.lit(False)))


def gap_fill(needed: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(node, origin): needed nodes from the primary where its bytes verify, else the fallback, else unresolved."""
    good = lambda b, name: verify_blocks(b).where("valid").select("node", F.lit(True).alias(name)).distinct()
    j = needed.select("node").distinct().join(good(primary, "p"), "node", "left").join(good(fallback, "f"), "node", "left")
    return j.select("node", F.when(F.col("p"), "primary").when(F.col("f"), "fallback").otherwise("unresolved").alias("origin"))


@query("jn18_gap_fill", """n AS (SELECT DISTINCT child AS node FROM links), b AS (SELECT node FROM blocks WHERE sha256(bytes) = digest)
    SELECT node, CASE WHEN node IN (SELECT node FROM b) THEN 'primary' WHEN node LIKE '%1' THEN 'fallback' ELSE 'unresolved' END AS origin FROM n""")
def jn18(spark, d):
    nodes = fx.links(spark, d).select(F.col("child").alias("node")).distinct()
    other = nodes.where("node LIKE '%1'").select("node", F.col("node").cast("binary").alias("bytes"), F.sha2(F.col("node").cast("binary"), 256).alias("digest"))
    return gap_fill(nodes, fx.blocks(spark, d), other)


def resolve_requests(requests: DataFrame, sub: DataFrame, files: DataFrame) -> DataFrame:
    """(req_id, status, detail) of requests (req_id, piece): what a pull of each gets, from sub-pieces and container files (car_path, length)."""
    j = requests.join(sub.withColumnRenamed("status", "built"), F.col("piece") == F.col("sub_piece_cid"), "left").join(files, "car_path", "left")
    return j.select(
        "req_id",
        F.when(F.col("built").isNull(), 404).when(F.col("built") != "built", 404).when(F.col("car_path").isNotNull() & F.col("length").isNull(), 404).when(F.col("car_path").isNotNull() & (F.col("length") != F.col("raw_size")), 500).when(F.col("car_path").isNotNull(), 200).when(F.col("url").isNotNull(), 302).otherwise(500).alias("status"),
        F.when(F.col("built").isNull(), "unknown piece").when(F.col("built") != "built", "sub-piece not built").when(F.col("car_path").isNotNull() & F.col("length").isNull(), "file missing").when(F.col("car_path").isNotNull() & (F.col("length") != F.col("raw_size")), "length drift").when(F.col("car_path").isNotNull(), F.col("car_path")).otherwise(F.col("url")).alias("detail"),
    )


def files_of(sub: DataFrame) -> DataFrame:
    """(car_path, length): container files; every 5th is absent and every 7th short."""
    k = F.col("sub_piece_cid")
    return sub.where("car_path IS NOT NULL AND sub_piece_cid % 5 <> 0").select("car_path", F.when(k % 7 == 0, F.col("raw_size") - 1).otherwise(F.col("raw_size")).alias("length"))


@query("jn19_resolve_requests", r"""q AS (SELECT req_id, CAST(path[8:] AS BIGINT) AS piece FROM requests WHERE regexp_matches(path, '^/piece/[0-9]{1,18}$'))
    SELECT req_id, CASE WHEN s.status IS NULL OR s.status <> 'built' OR (car_path IS NOT NULL AND sub_piece_cid % 5 = 0) THEN 404 WHEN car_path IS NOT NULL AND sub_piece_cid % 7 = 0 THEN 500 WHEN car_path IS NOT NULL THEN 200 ELSE 302 END AS status,
    CASE WHEN s.status IS NULL THEN 'unknown piece' WHEN s.status <> 'built' THEN 'sub-piece not built' WHEN car_path IS NOT NULL AND sub_piece_cid % 5 = 0 THEN 'file missing' WHEN car_path IS NOT NULL AND sub_piece_cid % 7 = 0 THEN 'length drift' ELSE coalesce(car_path, url) END AS detail FROM q LEFT JOIN sub_pieces s ON piece = sub_piece_cid""")
def jn19(spark, d):
    q = fx.requests(spark, d).select("req_id", c.piece_of_path(F.col("path")).alias("piece")).where("piece IS NOT NULL")
    s = fx.sub_pieces(spark, d)
    return resolve_requests(q, s, files_of(s))


def suggest(df: DataFrame, names: DataFrame, most: int = 3, bound: int = 1000) -> DataFrame:
    """df (name) with the nearest entry of names (entry, place) within an edit distance, ties to the least place.

    names is a small dictionary: its size is checked before every row meets it.
    """
    if names.limit(bound + 1).count() > bound:
        raise ValueError(f"a dictionary has at most {bound} entries")
    near = df.select("name").distinct().crossJoin(F.broadcast(names)).withColumn("dist", F.levenshtein("name", "entry", most)).where("dist >= 0")
    best = near.groupBy("name").agg(F.min_by("entry", F.struct("dist", "place")).alias("suggestion"))
    return df.join(best, "name", "left")


WORDS = ["ring", "widget", "bolt", "gear", "valve", "small", "large", "red", "green", "steel"]


@query("jn20_suggest", f"n AS (SELECT DISTINCT string_split(p_name, ' ')[1] || 'x' AS name FROM part), w AS (SELECT unnest({WORDS}) AS entry, unnest(range(0, {len(WORDS)})) AS place), b AS (SELECT name, arg_min(entry, levenshtein(name, entry) * 100 + place) AS suggestion FROM n, w WHERE levenshtein(name, entry) <= 3 GROUP BY name) SELECT n.name, suggestion FROM n LEFT JOIN b USING (name)")
def jn20(spark, d):
    n = fx.read(spark, d, "part").select(F.concat(F.get(F.split("p_name", " "), F.lit(0)), F.lit("x")).alias("name")).distinct()
    return suggest(n, spark.createDataFrame(list(zip(WORDS, range(len(WORDS)))), "entry string, place int"))


def match_resume(saved: DataFrame, run: DataFrame) -> DataFrame:
    """(id, run_id): saved records of the same owner in any case, network, and set of pieces."""
    key = lambda df, i: df.select(F.col("id").alias(i), F.lower("owner").alias("owner"), "network", F.sha2(F.array_join(F.array_sort(F.array_distinct("pieces")), ","), 256).alias("pieces"))
    return key(saved, "id").join(key(run, "run_id"), ["owner", "network", "pieces"]).select("id", "run_id")


@query("jn21_match_resume", "s AS (SELECT ctx, chunk, list_sort(list_distinct(piece_ids)) AS p FROM chunks WHERE chunk = 0), r AS (SELECT ctx, chunk, list_sort(list_distinct(piece_ids)) AS p FROM chunks WHERE chunk = 1) SELECT s.ctx AS id, r.ctx AS run_id FROM s JOIN r ON s.p = r.p AND s.ctx % 2 = r.ctx % 2")
def jn21(spark, d):
    c = fx.chunks(spark, d).select(F.col("ctx").alias("id"), "chunk", F.when(F.col("chunk") == 0, "0xAB").otherwise("0xab").alias("owner"), (F.col("ctx") % 2).alias("network"), F.col("piece_ids").alias("pieces"))
    return match_resume(c.where("chunk = 0"), c.where("chunk = 1"))
