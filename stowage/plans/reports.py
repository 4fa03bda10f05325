"""Reports of whole jobs: each composes operators and returns their own rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import columns as c
from ..operators import aggregations as ag
from ..operators import joins as jn
from ..operators import merkle as mk
from ..operators.rows import proof_health
from ..operators.windows import admit, n_members, nested_sample, walk
from ..registry import query
from .primitives import cut


def ledger_report(aggs: DataFrame, ledger: DataFrame, members: DataFrame, sub_members: DataFrame, pieces: DataFrame, proof: DataFrame) -> DataFrame:
    """One row: accounting of the ids that the ledger's own aggregates hold against pieces (cid, status), what the two sides miss, and the verdict.

    proof is one row (last_proven, next_challenge, current, max_add).
    """
    sides = jn.reconcile(aggs, ledger)
    held = sides.where("on_ledger").select("idx")
    counts = ag.piece_counts(pieces)
    account = ag.accounting(counts, ag.committed_stats(held, members, sub_members, pieces))
    verdict = ag.completeness(account, counts, jn.unaccounted_on_ledger(ledger, aggs), proof_health(proof).select("last_proven", "proven_since_add", "in_good_standing"))
    mismatches = sides.agg(*[F.count_if(F.col("mismatch") == m).alias(m) for m in ("committed_not_on_ledger", "on_ledger_not_committed")])
    return verdict.join(F.broadcast(mismatches))  # one row each


_ITEMS = """i AS (SELECT DISTINCT l_orderkey AS idx, l_orderkey || '/' || l_partkey AS cid, l_partkey AS k, CASE l_partkey % 20 WHEN 0 THEN 'failed' WHEN 1 THEN 'oversized' WHEN 2 THEN 'pending' ELSE 'done' END AS status FROM lineitem)"""


@query("job3_verdict", f"""{_ITEMS}, st AS (SELECT * FROM i WHERE k % 50 <> 49), m AS (SELECT i.cid, st.cid AS here FROM i JOIN aggregates USING (idx) LEFT JOIN st ON st.cid = i.cid WHERE i.status = 'done' AND i.idx IN (SELECT root FROM ledger)),
    n AS (SELECT count(*) FILTER (status IN ('pending','done')) AS p, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'oversized') AS oversized, count(*) AS t FROM st), s AS (SELECT count(*) AS every, count(here) AS held FROM m),
    a AS (SELECT held, failed, oversized, p < held AS short, every - held AS strange, greatest(0, p - held) AS pending, t - held - greatest(0, p - held) - failed - oversized AS rest FROM n, s), u AS (SELECT count(*) AS foreign_roots FROM ledger WHERE root NOT IN (SELECT idx FROM aggregates)),
    r AS (SELECT count(*) FILTER (status = 'committed' AND root IS NULL) AS c_only, count(*) FILTER (status <> 'committed' AND root IS NOT NULL) AS l_only FROM aggregates LEFT JOIN ledger ON idx = root),
    e AS (SELECT max(block) AS cur FROM receipts), x AS (SELECT max(block) AS latest FROM aggregates JOIN receipts ON tx = tx_hash WHERE status = 'committed'),
    v AS (SELECT *, greatest(0, rest) AS unaccounted, latest IS NULL OR cur - 10 >= latest AS proven FROM a, u, r, e, x),
    w AS (SELECT *, unaccounted = 0 AND pending = 0 AND failed = 0 AND oversized = 0 AND foreign_roots = 0 AND proven AS complete FROM v)
    SELECT held AS committed, pending AS pending_not_committed, unaccounted, failed, oversized, foreign_roots AS unaccounted_on_ledger, c_only AS committed_not_on_ledger, l_only AS on_ledger_not_committed,
    list_filter([CASE WHEN strange > 0 THEN strange || ' committed ids are not in the inventory' END, CASE WHEN short OR rest <> 0 THEN 'accounting does not conserve' END], lambda t: t IS NOT NULL) AS discrepancies,
    cur - 10 AS last_proven, proven AS proven_since_add, complete, CASE WHEN complete THEN 0 WHEN unaccounted > 0 OR foreign_roots > 0 THEN 2 ELSE 1 END AS severity FROM w""")
def job3_verdict(spark, d):
    """The report as a whole, each line of an order being a source id in a sub-piece of its own."""
    k = F.col("k")
    status = F.when(k % 20 == 0, "failed").when(k % 20 == 1, "oversized").when(k % 20 == 2, "pending").otherwise("done")
    items = fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_partkey").alias("k")).distinct()
    items = items.select("idx", "k", F.concat_ws("/", F.col("idx").cast("string"), k.cast("string")).alias("cid"), status.alias("status"))
    packed = items.where("status = 'done'")
    aggs, receipts = fx.aggregates(spark, d), fx.receipts(spark, d)
    proof = receipts.agg(F.max("block").alias("current")).join(F.broadcast(jn.latest_add_epoch(aggs, receipts)))
    proof = proof.select((F.col("current") - 10).alias("last_proven"), (F.col("current") + 2880).alias("next_challenge"), "current", F.col("latest").alias("max_add"))
    out = ledger_report(aggs, fx.ledger(spark, d), packed.select(F.col("idx").alias("aggregate_idx"), F.col("cid").alias("sub_piece_cid")), packed.select(F.col("cid").alias("sub_piece_cid"), F.col("cid").alias("member_cid")), items.where("k % 50 <> 49"), proof)
    return out.select("committed", "pending_not_committed", "unaccounted", "failed", "oversized", "unaccounted_on_ledger", "committed_not_on_ledger", "on_ledger_not_committed", "discrepancies", "last_proven", "proven_since_add", "complete", "severity")


def audit(members: DataFrame, stored: DataFrame, kept: DataFrame, segments: DataFrame, sub_members: DataFrame, probes: DataFrame, n: float, dealt: bool = False) -> DataFrame:
    """(idx, root_ok, replayed, n_sampled, n_announced, first_reason) of the aggregates of segments: whether the stored root (key, root) is that of the members, whether it had to be computed, and of a nested sample of n source ids those whose providers announce them.

    members are trees (key, order, height, node, raw_size, id); kept (key,
    digest, root) are an earlier audit's roots, which stand where the members
    haven't changed. segments are the walk over all memberships, as walk gives
    it from sub_members; probes are (member_cid, providers, reason).
    """
    now = mk.replayed_roots(members, kept, dealt).select("key", F.col("root").alias("now"), "replayed")
    checked = stored.join(now, "key", "left").select(F.col("key").alias("idx"), F.coalesce(F.col("root") == F.col("now"), F.lit(False)).alias("root_ok"), F.coalesce("replayed", F.lit(False)).alias("replayed"))
    sample = nested_sample(segments, sub_members, n_members(segments, sub_members), n).withColumnRenamed("idx", "_at").join(probes, "member_cid", "left")
    announced = F.coalesce(F.col("providers") > 0, F.lit(False))
    counts = sample.groupBy(F.col("aggregate_idx").alias("idx")).agg(F.count("*").alias("n_sampled"), F.count_if(announced).alias("n_announced"), F.min_by(F.coalesce("reason", F.lit("not probed")), F.when(~announced, F.col("_at"))).alias("first_reason"))
    held = segments.select(F.col("aggregate_idx").alias("idx")).distinct()
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return held.join(checked, "idx").join(counts, "idx", "left").select("idx", "root_ok", "replayed", zero("n_sampled"), zero("n_announced"), "first_reason")


@query("job3_audit", f"""{mk.LAID_SQL}, wo AS (SELECT aggregate_idx, member_cid, row_number() OVER (ORDER BY aggregate_idx, segment_index, member_sort_order) - 1 AS i FROM aggregate_members JOIN sub_piece_members USING (sub_piece_cid) WHERE aggregate_idx IN (SELECT root FROM ledger)), wp AS (SELECT count(DISTINCT member_cid) AS n FROM wo),
    ws AS (SELECT wo.* FROM wo JOIN (SELECT CAST(floor(j * (wp.n::DOUBLE / least(40, wp.n))) AS BIGINT) AS i FROM wp, (SELECT unnest(range(40)) AS j) WHERE j < least(40, wp.n)) AS r USING (i)),
    wc AS (SELECT aggregate_idx AS idx, count(*) AS n_sampled, count(*) FILTER (member_cid % 4 > 0 AND member_cid % 5 > 0) AS n_announced, arg_min(CASE WHEN member_cid % 5 = 0 THEN 'not probed' ELSE 'none found for ' || member_cid END, i) FILTER (member_cid % 4 = 0 OR member_cid % 5 = 0) AS first_reason FROM ws GROUP BY 1)
    SELECT key AS idx, key % 9 <> 0 AS root_ok, key % 5 = 0 OR key % 7 = 0 AS replayed, coalesce(n_sampled, 0) AS n_sampled, coalesce(n_announced, 0) AS n_announced, first_reason FROM roots LEFT JOIN wc ON key = idx WHERE key IN (SELECT aggregate_idx FROM wo)""")
def job3_audit(spark, d):
    """The part of a report that replays roots and samples source ids: aggregates on the ledger, with roots of an earlier audit of which some are new or changed."""
    m = mk.tree_members(spark, d, kept=True)
    k = F.col("key")
    before = m.where(k % 5 != 0).withColumn("node", F.when(k % 7 == 0, F.unhex(F.lit("ab" * 32))).otherwise(F.col("node")))
    kept = mk.digested_roots(before, dealt=True)
    stored = mk.aggregate_roots(m, dealt=True).select("key", F.when(k % 9 == 0, F.lit("0" * 64)).otherwise(F.col("root")).alias("root"))
    on = fx.ledger(spark, d).select(F.col("root").alias("aggregate_idx"))
    members, sub_members = fx.aggregate_members(spark, d).join(on, "aggregate_idx", "left_semi"), cut(fx.sub_piece_members(spark, d))
    segments = cut(walk(members, sub_members))
    cid = F.col("s_suppkey")
    probes = fx.read(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(cid.alias("member_cid"), (cid % 4).alias("providers"), F.concat(F.lit("none found for "), cid.cast("string")).alias("reason"))
    return audit(m, stored, kept, segments, sub_members, probes, 40.5, dealt=True)


def source_report(attempts: DataFrame, free_bytes: int | None, in_flight: int) -> DataFrame:
    """Per source: probes, success, median latency, ids that it gave alike or not, and the cache mode that its failures call for."""
    same = ag.determinism(attempts).groupBy("source").agg(F.count_if("deterministic").alias("n_alike"), F.count_if(~F.col("deterministic")).alias("n_varying"))
    rate, free = 1 - F.col("success"), F.lit(free_bytes).cast("long")
    quality = ag.source_quality(attempts).join(same, "source", "left")
    return quality.withColumn("mode", c.cache_mode(F.lit(in_flight), free, rate)).withColumn("n_warnings", F.size(c.cache_warnings(F.lit(in_flight), free, rate)))


@query("job4_sources", """q AS (SELECT source, count(*) AS probes, avg(CAST(ok AS INT)) AS success, list_sort(list(latency_ms))[least(count(*) - 1, CAST(floor(0.5 * count(*)) AS BIGINT)) + 1] AS p50 FROM attempts GROUP BY source),
    t AS (SELECT source, id, count(DISTINCT digest) = 1 AS alike FROM attempts WHERE ok GROUP BY source, id), n AS (SELECT source, count(*) FILTER (alike) AS n_alike, count(*) FILTER (NOT alike) AS n_varying FROM t GROUP BY source)
    SELECT source, probes, success, p50, n_alike, n_varying, CASE WHEN 1 - success > 0.05 THEN 'required' ELSE 'recommended' END AS mode, 1 AS n_warnings FROM q LEFT JOIN n USING (source)""")
def job4_sources(spark, d):
    """The part of an analysis that is about sources; free space isn't known."""
    return source_report(fx.attempts(spark, d), None, 1)


def status_sections(pieces: DataFrame, view: DataFrame) -> DataFrame:
    """(section, name, n): pieces by status, failures by category, aggregates by status, and the source ids in them; view is the aggregates with n_members."""
    counts = ag.piece_counts(pieces).unpivot([], ["pending", "processing", "done", "failed", "oversized", "total"], "name", "n")
    held = view.groupBy(F.col("status").alias("name")).agg(F.sum("n_members").alias("n"))
    parts = {"pieces": counts, "failures": ag.failures_by_category(pieces).withColumnRenamed("category", "name"), "aggregates": ag.aggregates_by_status(view).withColumnRenamed("status", "name"), "members": held}
    return reduce(DataFrame.union, [df.select(F.lit(section).alias("section"), "name", F.col("n").cast("long").alias("n")) for section, df in parts.items()])


@query("job5_sections", """g AS (SELECT sub_piece_cid, count(*) AS n FROM sub_piece_members GROUP BY 1), h AS (SELECT aggregate_idx AS idx, sum(n) AS n FROM aggregate_members JOIN g USING (sub_piece_cid) GROUP BY 1)
    SELECT 'pieces' AS section, s.s AS name, (SELECT count(*) FROM pieces WHERE status = s.s) AS n FROM (SELECT unnest(['pending','processing','done','failed','oversized']) AS s) s UNION ALL SELECT 'pieces', 'total', count(*) FROM pieces
    UNION ALL SELECT 'failures', coalesce(failure_category, 'other'), count(*) FROM pieces WHERE status = 'failed' GROUP BY 2 UNION ALL SELECT 'aggregates', status, count(*) FROM aggregates GROUP BY 2
    UNION ALL SELECT 'members', status, CAST(sum(coalesce(n, 0)) AS BIGINT) FROM aggregates LEFT JOIN h USING (idx) GROUP BY 2""")
def job5_sections(spark, d):
    view = ag.aggregates_view(fx.aggregates(spark, d), fx.aggregate_members(spark, d), fx.sub_piece_members(spark, d))
    return status_sections(fx.pieces(spark, d), view)


def advance(aggs: DataFrame, cap: int, fees: DataFrame, ledger: DataFrame, events: DataFrame) -> DataFrame:
    """(idx, action, decision, outcome, piece_id): what is admitted, what to do with it, and for what is committed by its transaction how the event confirms it."""
    go = admit(aggs, cap, fees)
    admitted = aggs.join(go.select("idx"), "idx", "left_semi")
    decided = go.join(jn.resume_decision(admitted, ledger, events), "idx")
    commit = decided.where(F.col("decision").startswith("commit")).select("idx")
    return decided.join(jn.confirm_events(admitted.join(commit, "idx", "left_semi"), events), "idx", "left").select("idx", "action", "decision", "outcome", "piece_id")


@query("job7_flow", """b AS (SELECT count(*) FILTER (status IN ('submitted','parked','add_unconfirmed')) AS busy FROM aggregates), f AS (SELECT arg_max(fee, event_id) >= 200000 AS pause FROM fees WHERE ts = (SELECT max(ts) FROM fees)), s AS (SELECT CASE WHEN pause THEN 0 ELSE greatest(0, 12100 - busy) END AS slots FROM b, f),
    g AS (SELECT idx, 'resume' AS action FROM aggregates WHERE status IN ('submitted','parked','add_unconfirmed') UNION ALL SELECT idx, 'start' FROM (SELECT idx, row_number() OVER (ORDER BY idx) AS n FROM aggregates WHERE status = 'planned'), s WHERE n <= slots AND n <= 12100),
    r AS (SELECT idx, action, status, tx_hash, tx, roots, piece_ids, root IS NOT NULL AS o, coalesce(list_contains(roots, idx), false) AS l FROM g JOIN aggregates USING (idx) LEFT JOIN ledger ON idx = root LEFT JOIN added_events ON tx = tx_hash),
    q AS (SELECT *, CASE WHEN tx_hash IS NOT NULL THEN CASE WHEN NOT o THEN 'wait' WHEN l THEN 'commit' ELSE 'commit_unverified' END WHEN status = 'add_unconfirmed' THEN CASE WHEN o THEN 'commit' ELSE 'hold' END WHEN o THEN 'already_on_ledger' ELSE 'proceed' END AS decision FROM r)
    SELECT idx, action, decision, CASE WHEN decision LIKE 'commit%' AND tx_hash IS NOT NULL THEN CASE WHEN tx IS NULL THEN 'committed_unverified' WHEN l THEN 'committed' ELSE 'root_mismatch' END END AS outcome, CASE WHEN decision LIKE 'commit%' AND l THEN piece_ids[list_position(roots, idx)] END AS piece_id FROM q""")
def job7_flow(spark, d):
    return advance(fx.aggregates(spark, d), 12100, fx.fees(spark, d), fx.ledger(spark, d), fx.added_events(spark, d))


def verify_contexts(prepared: DataFrame, active: DataFrame) -> DataFrame:
    """Per ctx of prepared and active (ctx, piece): found, missing and unrecognized pieces, and those missing that another context's active pieces settle."""
    key = F.struct("ctx", "piece").alias("key")
    each = jn.verify_set(prepared.select(key), active.select(key)).select("key.ctx", "key.piece", "verdict")
    settled = jn.settle_deferred(each.where("verdict = 'missing'"), active.select("piece")).where("settled")
    counts = each.groupBy("ctx").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("found", "missing", "unrecognized")])
    return counts.join(settled.groupBy("ctx").agg(F.count("*").alias("settled")), "ctx", "left").withColumn("settled", F.coalesce("settled", F.lit(0)))


@query("job8_contexts", """x AS (SELECT ctx, chunk, committed, unnest(piece_ids) AS piece FROM chunks), p AS (SELECT DISTINCT ctx, piece FROM x WHERE chunk % 4 <> 3), a AS (SELECT DISTINCT ctx, piece FROM x WHERE committed), j AS (SELECT coalesce(p.ctx, a.ctx) AS ctx, coalesce(p.piece, a.piece) AS piece, p.ctx IS NULL AS un, a.ctx IS NULL AS miss FROM p FULL JOIN a ON p.ctx = a.ctx AND p.piece = a.piece)
    SELECT ctx, count(*) FILTER (NOT un AND NOT miss) AS found, count(*) FILTER (miss) AS missing, count(*) FILTER (un) AS unrecognized, count(*) FILTER (miss AND piece IN (SELECT piece FROM a)) AS settled FROM j GROUP BY ctx""")
def job8_contexts(spark, d):
    t = fx.chunks(spark, d).select("ctx", "chunk", "committed", F.explode("piece_ids").alias("piece"))
    return verify_contexts(t.where("chunk % 4 <> 3").select("ctx", "piece"), t.where("committed").select("ctx", "piece"))
