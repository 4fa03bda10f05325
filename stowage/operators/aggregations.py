"""Counts, accounting, rates and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import columns as c
from ..registry import query
from .joins import reconcile

IN_FLIGHT = ("submitted", "parked", "add_unconfirmed")


def piece_counts(pieces: DataFrame) -> DataFrame:
    return pieces.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "done", "failed", "oversized")], F.count("*").alias("total"))


@query("ag1_piece_counts", "SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'oversized') AS oversized, count(*) AS total FROM pieces")
def ag1(spark, d):
    return piece_counts(fx.pieces(spark, d))


def failures_by_category(pieces: DataFrame) -> DataFrame:
    return pieces.where("status = 'failed'").groupBy(F.coalesce("failure_category", F.lit("other")).alias("category")).agg(F.count("*").alias("n"))


@query("ag2_failures_by_category", "SELECT coalesce(failure_category, 'other') AS category, count(*) AS n FROM pieces WHERE status = 'failed' GROUP BY 1")
def ag2(spark, d):
    return failures_by_category(fx.pieces(spark, d))


def aggregates_by_status(aggs: DataFrame) -> DataFrame:
    return aggs.groupBy("status").agg(F.count("*").alias("n"))


@query("ag3_aggregates_by_status", "SELECT status, count(*) AS n FROM aggregates GROUP BY status")
def ag3(spark, d):
    return aggregates_by_status(fx.aggregates(spark, d))


def aggregates_view(aggs: DataFrame, members: DataFrame, sub_members: DataFrame) -> DataFrame:
    """Each aggregate with its number of source ids; per sub-piece counts are made before the join."""
    per = sub_members.groupBy("sub_piece_cid").agg(F.count("*").alias("n"))
    n = members.join(per, "sub_piece_cid").groupBy(F.col("aggregate_idx").alias("idx")).agg(F.sum("n").alias("n_members"))
    return aggs.join(n, "idx", "left").withColumn("n_members", F.coalesce("n_members", F.lit(0)))


@query("ag4_aggregates_view", "SELECT idx, status, (SELECT count(*) FROM aggregate_members m JOIN sub_piece_members s USING (sub_piece_cid) WHERE m.aggregate_idx = idx) AS n_members FROM aggregates")
def ag4(spark, d):
    return aggregates_view(fx.aggregates(spark, d), fx.aggregate_members(spark, d), fx.sub_piece_members(spark, d)).select("idx", "status", "n_members")


def committed_stats(idxs: DataFrame, members: DataFrame, sub_members: DataFrame, local: DataFrame) -> DataFrame:
    """(total, in_pieces): distinct source ids of the aggregates in idxs, and those of them in local (cid)."""
    subs = members.join(idxs.select(F.col("idx").alias("aggregate_idx")).distinct(), "aggregate_idx", "left_semi").select("sub_piece_cid").distinct()
    ids = sub_members.join(subs, "sub_piece_cid", "left_semi").select(F.col("member_cid").alias("cid")).distinct()
    marked = ids.join(local.select("cid", F.lit(1).alias("here")).distinct(), "cid", "left")
    return marked.agg(F.count("*").alias("total"), F.count("here").alias("in_pieces"))


@query("ag5_committed_stats", "x AS (SELECT DISTINCT member_cid FROM sub_piece_members WHERE sub_piece_cid IN (SELECT sub_piece_cid FROM aggregate_members WHERE aggregate_idx IN (SELECT root FROM ledger))) SELECT count(*) AS total, count(*) FILTER (member_cid % 3 <> 0 AND member_cid IN (SELECT s_suppkey FROM supplier)) AS in_pieces FROM x")
def ag5(spark, d):
    on = fx.ledger(spark, d).select(F.col("root").alias("idx"))
    local = fx.read(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("cid"))
    return committed_stats(on, fx.aggregate_members(spark, d), fx.sub_piece_members(spark, d), local)


def in_flight(aggs: DataFrame) -> DataFrame:
    return aggs.agg(F.count_if(F.col("status").isin(*IN_FLIGHT)).alias("in_flight"))


@query("ag6_in_flight", "SELECT count(*) FILTER (status IN ('submitted','parked','add_unconfirmed')) AS in_flight FROM aggregates")
def ag6(spark, d):
    return in_flight(fx.aggregates(spark, d))


def accounting(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """One row that must conserve: committed, pending_not_committed, unaccounted, and a message for each violation."""
    pending = F.col("pending") + F.col("processing") + F.col("done") - F.col("in_pieces")
    left = F.greatest(F.lit(0), pending)
    rest = F.col("total") - F.col("in_pieces") - left - F.col("failed") - F.col("oversized")
    messages = F.array_compact(F.array(F.when(F.col("all_ids") > F.col("in_pieces"), F.concat((F.col("all_ids") - F.col("in_pieces")).cast("string"), F.lit(" committed ids are not in the inventory"))), F.when((pending < 0) | (rest != 0), F.lit("accounting does not conserve"))))
    return counts.join(F.broadcast(stats.withColumnRenamed("total", "all_ids"))).select(F.col("in_pieces").alias("committed"), left.alias("pending_not_committed"), F.greatest(F.lit(0), rest).alias("unaccounted"), messages.alias("discrepancies"))




@query("ag7_accounting", "c AS (SELECT count(*) FILTER (status IN ('pending','processing','done')) AS p, count(*) FILTER (status IN ('failed','oversized')) AS f, count(*) AS t, count(*) FILTER (k % 2 = 0) AS i FROM pieces) SELECT i AS committed, greatest(0, p - i) AS pending_not_committed, greatest(0, t - i - greatest(0, p - i) - f) AS unaccounted, CASE WHEN p < i OR t - i - greatest(0, p - i) - f <> 0 THEN ['5 committed ids are not in the inventory', 'accounting does not conserve'] ELSE ['5 committed ids are not in the inventory'] END AS discrepancies FROM c")
def ag7(spark, d):
    p = fx.pieces(spark, d)
    return accounting(piece_counts(p), p.agg(F.count_if(F.col("k") % 2 == 0).alias("in_pieces"), (F.count_if(F.col("k") % 2 == 0) + 5).alias("total")))


def floor_percentile(df: DataFrame, group: list[str], value: str, p: float, name: str = "p") -> DataFrame:
    """The element at place min(n - 1, floor(p * n)) of each group's ascending values.

    Values are counted first, so the running counts see a value once however
    many rows have it.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group)
    run = n.withColumn("_c", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("_n").over(w))
    at = F.least(F.col("_t") - 1, F.floor(F.lit(p) * F.col("_t")))
    return run.where((at < F.col("_c")) & (at >= F.col("_c") - F.col("_n"))).select(*group, F.col(value).alias(name))


def _pct(p: float, group: str, value: str) -> str:
    return f"list_sort(list({value}))[least(count(*) - 1, CAST(floor({p} * count(*)) AS BIGINT)) + 1]"


@query("ag8_source_quality", f"SELECT source, count(*) AS probes, avg(CAST(ok AS INT)) AS success, {_pct(0.5, 'source', 'latency_ms')} AS p50 FROM attempts GROUP BY source")
def ag8(spark, d):
    return source_quality(fx.attempts(spark, d))


def source_quality(probes: DataFrame) -> DataFrame:
    return probes.groupBy("source").agg(F.count("*").alias("probes"), F.avg(F.col("ok").cast("int")).alias("success")).join(floor_percentile(probes, ["source"], "latency_ms", 0.5, "p50"), "source", "left")


def determinism(fetches: DataFrame) -> DataFrame:
    return fetches.where("ok").groupBy("id", "source").agg(F.count("*").alias("n"), (F.min("digest") == F.max("digest")).alias("deterministic"))


@query("ag9_determinism", "SELECT id, source, count(*) AS n, count(DISTINCT digest) = 1 AS deterministic FROM attempts WHERE ok GROUP BY id, source")
def ag9(spark, d):
    return determinism(fx.attempts(spark, d))


@query("ag10_floor_percentile", f"SELECT id, {_pct(0.95, 'id', 'latency_ms')} AS p95 FROM attempts GROUP BY id")
def ag10(spark, d):
    return floor_percentile(fx.attempts(spark, d), ["id"], "latency_ms", 0.95, "p95")


def stage_summary(spans: DataFrame) -> DataFrame:
    """spans (stage, started_ms, ms, bytes): items, bytes, wall time, p50 and p95 of each stage."""
    base = spans.groupBy("stage").agg(F.count("*").alias("items"), F.sum("bytes").alias("bytes"), (F.max(F.col("started_ms") + F.col("ms")) - F.min("started_ms")).alias("wall_ms"))
    return base.join(floor_percentile(spans, ["stage"], "ms", 0.5, "p50"), "stage", "left").join(floor_percentile(spans, ["stage"], "ms", 0.95, "p95"), "stage", "left")


@query("ag11_stage_summary", f"s AS (SELECT source AS stage, epoch_us(started) // 1000 AS started_ms, latency_ms AS ms, bytes FROM attempts) SELECT stage, count(*) AS items, sum(bytes) AS bytes, max(started_ms + ms) - min(started_ms) AS wall_ms, {_pct(0.5, '', 'ms')} AS p50, {_pct(0.95, '', 'ms')} AS p95 FROM s GROUP BY stage")
def ag11(spark, d):
    return stage_summary(fx.attempts(spark, d).select(F.col("source").alias("stage"), F.unix_millis(F.col("started").cast("timestamp")).alias("started_ms"), F.col("latency_ms").alias("ms"), "bytes"))


def extrapolate(sample: DataFrame, total: DataFrame) -> DataFrame:
    return sample.agg(F.avg("raw_size").alias("mean")).join(F.broadcast(total.agg(F.count("*").alias("n")))).select(F.floor(F.col("mean") * F.col("n") + 0.5).alias("estimated_bytes"))


@query("ag12_extrapolate", "SELECT CAST(floor(avg(raw_size) * (SELECT count(*) FROM objects) + 0.5) AS BIGINT) AS estimated_bytes FROM objects WHERE object_id % 10 = 0")
def ag12(spark, d):
    o = fx.objects(spark, d).select("object_id", "raw_size")
    return extrapolate(o.where("object_id % 10 = 0"), o)


def batch_outcome(status: DataFrame) -> DataFrame:
    """status (batch, state): whether all are complete or failed, and the counts."""
    return status.groupBy("batch").agg(F.bool_and(F.col("state").isin("committed", "failed")).alias("terminal"), F.count_if(F.col("state") == "committed").alias("n_ok"), F.count_if(F.col("state") == "failed").alias("n_failed"))


@query("ag13_batch_outcome", "SELECT key AS batch, bool_and(kind IN ('committed','failed')) AS terminal, count(*) FILTER (kind = 'committed') AS n_ok, count(*) FILTER (kind = 'failed') AS n_failed FROM lifecycle GROUP BY key")
def ag13(spark, d):
    return batch_outcome(fx.lifecycle(spark, d).select(F.col("key").alias("batch"), F.col("kind").alias("state")))


def announcement(probes: DataFrame) -> DataFrame:
    """probes (id, providers, reason): totals and the first five reasons by id."""
    reasons = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("id", "reason"))), 1, 5), lambda x: x["reason"])
    first = probes.where("providers = 0").orderBy("id").limit(5).agg(reasons.alias("reasons"))
    return probes.agg(F.count("*").alias("probed"), F.count_if(F.col("providers") > 0).alias("announced"), F.count_if(F.col("providers") == 0).alias("not_announced")).join(F.broadcast(first))


@query("ag14_announcement", "p AS (SELECT event_id AS id, CASE WHEN ok THEN 1 ELSE 0 END AS providers, message AS reason FROM attempts) SELECT count(*) AS probed, count(*) FILTER (providers > 0) AS announced, count(*) FILTER (providers = 0) AS not_announced, (SELECT list(reason ORDER BY id) FROM (SELECT id, reason FROM p WHERE providers = 0 ORDER BY id LIMIT 5)) AS reasons FROM p")
def ag14(spark, d):
    return announcement(fx.attempts(spark, d).select(F.col("event_id").alias("id"), F.col("ok").cast("int").alias("providers"), F.col("message").alias("reason")))


def run_summary(events: DataFrame) -> DataFrame:
    """events (run, kind, bytes, ms): committed items and bytes, pull and add time, bytes a second."""
    total = F.sum("ms")
    return events.groupBy("run").agg(F.count_if(F.col("kind") == "committed").alias("committed"), F.coalesce(F.sum(F.when(F.col("kind") == "committed", F.col("bytes"))), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(F.col("kind") == "parked", F.col("ms"))), F.lit(0)).alias("pull_ms"), (F.coalesce(F.sum(F.when(F.col("kind") == "committed", F.col("bytes"))), F.lit(0)) * 1000.0 / F.nullif(total, F.lit(0))).alias("rate"))


@query("ag16_run_summary", "e AS (SELECT key % 20 AS run, kind, seq % 1000 AS bytes, seq % 77 AS ms FROM lifecycle) SELECT run, count(*) FILTER (kind = 'committed') AS committed, coalesce(sum(bytes) FILTER (kind = 'committed'), 0) AS bytes, coalesce(sum(ms) FILTER (kind = 'parked'), 0) AS pull_ms, coalesce(sum(bytes) FILTER (kind = 'committed'), 0) * 1000.0 / nullif(sum(ms), 0) AS rate FROM e GROUP BY run")
def ag16(spark, d):
    return run_summary(fx.lifecycle(spark, d).select((F.col("key") % 20).alias("run"), "kind", (F.col("seq") % 1000).alias("bytes"), (F.col("seq") % 77).alias("ms")))


@query("ag17_plan_summary", "SELECT (SELECT count(*) FROM pieces WHERE status = 'done') AS done, (SELECT count(*) FROM pieces WHERE status = 'failed') AS failed, (SELECT count(*) FROM pieces WHERE status = 'done' AND url IS NULL) AS unservable, (SELECT coalesce(sum(raw_size), 0) FROM pieces WHERE status = 'done') AS bytes")
def ag17(spark, d):
    p = fx.pieces(spark, d)
    done = F.col("status") == "done"
    return p.agg(F.count_if(done).alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(done & F.col("url").isNull()).alias("unservable"), F.coalesce(F.sum(F.when(done, F.col("raw_size"))), F.lit(0)).alias("bytes"))


def import_summary(plan: DataFrame) -> DataFrame:
    """Of an import's plan (cid, plan): rows, those to record, those recorded already, and conflicts."""
    return plan.agg(F.count("*").alias("total"), F.count_if(F.col("plan").isin("new", "upgrade")).alias("imported"), F.count_if(F.col("plan") == "recorded").alias("recorded"), F.count_if(F.col("plan") == "conflict").alias("conflicts"))


def pack_summary(members: DataFrame) -> DataFrame:
    """Of packed members (group, bin, sound): bins, those built, those that failed, and the members of the latter."""
    bins = members.groupBy("group", "bin").agg(F.bool_and("sound").alias("sound"), F.count("*").alias("n"))
    return bins.agg(F.count("*").alias("bins"), F.count_if("sound").alias("built"), F.count_if(~F.col("sound")).alias("failed"), F.coalesce(F.sum(F.when(~F.col("sound"), F.col("n"))), F.lit(0)).alias("failed_members"))


def probed_quality(probes: DataFrame) -> DataFrame:
    """source_quality with deterministic: the share of probes that worked and whose id and source gave one digest throughout."""
    alike = determinism(probes).where("deterministic").select("id", "source", F.lit(True).alias("alike"))
    rate = probes.join(alike, ["id", "source"], "left").groupBy("source").agg(F.avg(F.coalesce(F.col("ok") & F.col("alike"), F.lit(False)).cast("int")).alias("deterministic"))
    return source_quality(probes).join(rate, "source")


@query("ag8_deterministic_rate", f"""g AS (SELECT id, source FROM attempts WHERE ok GROUP BY 1, 2 HAVING count(DISTINCT digest) = 1), q AS (SELECT source, count(*) AS probes, avg(CAST(ok AS INT)) AS success, {_pct(0.5, 'source', 'latency_ms')} AS p50, avg(CAST(ok AND (id, source) IN (SELECT (id, source) FROM g) AS INT)) AS deterministic FROM attempts GROUP BY source)
    SELECT *, list_filter([CASE WHEN deterministic < 1 THEN 'answers varied on ' || (probes - CAST(floor(deterministic * probes + 0.5) AS BIGINT)) || ' of ' || probes || ' probes' END, CASE WHEN p50 > 500 THEN 'median latency of ' || p50 || ' ms is above 500' END, 'upload wasn''t measured'], lambda t: t IS NOT NULL) AS warnings FROM q""")
def ag8_deterministic(spark, d):
    q = probed_quality(fx.attempts(spark, d))
    return q.withColumn("warnings", c.source_warnings(F.col("probes"), F.col("deterministic"), F.col("p50"), F.lit(None).cast("double")))


def first_success(attempts: DataFrame) -> DataFrame:
    """(id, ok, source, category): the first source by rank that worked, else the first category other than "other"."""
    order = F.struct("rank", "event_id")
    a = attempts.groupBy("id").agg(F.min_by("source", F.when(F.col("ok"), order)).alias("source"), F.bool_or("ok").alias("ok"), F.min_by("category", F.when(~F.col("ok") & (F.col("category") != "other"), order)).alias("c"))
    return a.select("id", "ok", F.when(F.col("ok"), F.col("source")).alias("source"), F.when(~F.col("ok"), F.coalesce("c", F.lit("other"))).alias("category"))


#: Two thirds of the ids have no attempt that worked.
_FIRST = """a AS (SELECT id, rank, event_id, ok AND id % 3 = 0 AS ok, source, CASE WHEN message LIKE 'received 429 %' THEN 'source_gateway_429' ELSE 'other' END AS c FROM attempts),
    f AS (SELECT id, bool_or(ok) AS ok, arg_min(source, rank * 1000000000 + event_id) FILTER (ok) AS source, arg_min(c, rank * 1000000000 + event_id) FILTER (NOT ok AND c <> 'other') AS c FROM a GROUP BY id)"""


def _attempted(spark, d):
    a = fx.attempts(spark, d).withColumn("ok", F.col("ok") & (F.col("id") % 3 == 0))
    return a.withColumn("category", F.when(~F.col("ok"), F.when(F.col("message").startswith("received 429 "), "source_gateway_429").otherwise("other")))


@query("ag18_first_success", f"{_FIRST} SELECT id, ok, source, CASE WHEN NOT ok THEN coalesce(c, 'other') END AS category FROM f")
def ag18(spark, d):
    return first_success(_attempted(spark, d))


def record_outcome(first: DataFrame, fallback: str = "g3") -> DataFrame:
    """(id, status, failure_category): a result that only the fallback could fetch can't be served."""
    only = F.col("ok") & (F.col("source") == fallback)
    return first.select("id", F.when(F.col("ok") & ~only, "done").otherwise("failed").alias("status"), F.when(only, "unservable_fallback_only").otherwise(F.col("category")).alias("failure_category"))


@query("ag19_record_outcome", f"{_FIRST} SELECT id, CASE WHEN ok AND source <> 'g3' THEN 'done' ELSE 'failed' END AS status, CASE WHEN ok AND source = 'g3' THEN 'unservable_fallback_only' WHEN NOT ok THEN coalesce(c, 'other') END AS failure_category FROM f")
def ag19(spark, d):
    return record_outcome(first_success(_attempted(spark, d)))


@query("ag20_deferred_ids", "SELECT DISTINCT unnest(piece_ids) AS piece FROM chunks WHERE NOT committed")
def ag20(spark, d):
    return deferred_ids(fx.chunks(spark, d).where("NOT committed"))


def deferred_ids(ctx: DataFrame) -> DataFrame:
    return ctx.select(F.explode("piece_ids").alias("piece")).distinct()


@query("ag21_context_piece_ids", "SELECT ctx, flatten(list(piece_ids ORDER BY chunk)) AS pieces FROM chunks WHERE committed GROUP BY ctx")
def ag21(spark, d):
    return context_piece_ids(fx.chunks(spark, d))


def context_piece_ids(chunks: DataFrame) -> DataFrame:
    return chunks.where("committed").groupBy("ctx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece_ids"))), lambda x: x["piece_ids"])).alias("pieces"))


def single_value(df: DataFrame, column: str) -> DataFrame:
    """(n_values, single, least): whether all rows have one value; assert_single() refuses otherwise."""
    return df.agg(F.countDistinct(column).alias("n_values"), (F.min(column) == F.max(column)).alias("single"), F.min(column).alias("least"))


def assert_single(df: DataFrame, column: str) -> str:
    values = [r[0] for r in df.select(column).distinct().limit(11).collect()]
    if len(values) > 1:
        raise ValueError(f"rows have several values of {column}: {', '.join(map(str, sorted(values)[:10]))}")
    return values[0] if values else ""


@query("ag22_single_source", "SELECT count(DISTINCT gateway) AS n_values, count(DISTINCT gateway) = 1 AS single, min(gateway) AS least FROM pieces")
def ag22(spark, d):
    return single_value(fx.pieces(spark, d), "gateway")


def completeness(account: DataFrame, counts: DataFrame, foreign: DataFrame, proof: DataFrame) -> DataFrame:
    """One row: complete only if everything is accounted, nothing failed or oversized, the ledger has nothing foreign, and proofs are good."""
    one = account.join(F.broadcast(counts.select("failed", "oversized"))).join(F.broadcast(foreign.agg(F.count("*").alias("unaccounted_on_ledger")))).join(F.broadcast(proof))
    zero = (F.col("unaccounted") == 0) & (F.col("pending_not_committed") == 0) & (F.col("failed") == 0) & (F.col("oversized") == 0) & (F.col("unaccounted_on_ledger") == 0)
    done = zero & F.col("proven_since_add") & F.col("in_good_standing")
    return one.withColumn("complete", done).withColumn("severity", F.when(done, 0).when((F.col("unaccounted") > 0) | (F.col("unaccounted_on_ledger") > 0), 2).otherwise(1))


@query("job3_report", """s AS (SELECT idx, status, root IS NOT NULL AS on_ledger FROM aggregates LEFT JOIN ledger ON idx = root), n AS (SELECT aggregate_idx AS idx, count(*) AS segments FROM aggregate_members GROUP BY 1)
    SELECT idx, status, on_ledger, coalesce(segments, 0) AS segments, CASE WHEN status = 'committed' AND NOT on_ledger THEN 'committed_not_on_ledger' WHEN status <> 'committed' AND on_ledger THEN 'on_ledger_not_committed' END AS mismatch FROM s LEFT JOIN n USING (idx)""")
def job3(spark, d):
    """Per aggregate: status, presence on the ledger, member count and mismatch."""
    n = fx.aggregate_members(spark, d).groupBy(F.col("aggregate_idx").alias("idx")).agg(F.count("*").alias("segments"))
    return reconcile(fx.aggregates(spark, d), fx.ledger(spark, d)).join(n, "idx", "left").select("idx", "status", "on_ledger", F.coalesce("segments", F.lit(0)).alias("segments"), "mismatch")


@query("row18_completeness", """c AS (SELECT count(*) FILTER (status IN ('pending','processing','done')) AS p, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'oversized') AS oversized, count(*) AS t, count(*) FILTER (k % 2 = 0) AS i FROM pieces), u AS (SELECT count(*) AS u FROM ledger WHERE root NOT IN (SELECT idx FROM aggregates))
    SELECT greatest(0, p - i) AS pending_not_committed, failed, oversized, u AS unaccounted_on_ledger, false AS complete, 2 AS severity FROM c, u""")
def row18(spark, d):
    from .joins import unaccounted_on_ledger

    p = fx.pieces(spark, d)
    counts = piece_counts(p)
    acc = accounting(counts, p.agg(F.count_if(F.col("k") % 2 == 0).alias("in_pieces"), F.count_if(F.col("k") % 2 == 0).alias("total")))
    proof = fx.receipts(spark, d).agg((F.max("block") > 0).alias("proven_since_add"), (F.max("block") > 0).alias("in_good_standing"))
    return completeness(acc, counts, unaccounted_on_ledger(fx.ledger(spark, d), fx.aggregates(spark, d)), proof).select("pending_not_committed", "failed", "oversized", "unaccounted_on_ledger", "complete", "severity")
