"""Samples, first occurrences, admission and time-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import columns as c
from ..plans.primitives import cut, global_prefix, places_within
from ..registry import query
from .joins import numbered_members, sized_segments


def stride_sample(df: DataFrame, order: list, n: int) -> DataFrame:
    """Rows at floor(i * total / n), i in 0..n-1, by a closed form of their place; all rows where n is not less."""
    placed = cut(global_prefix(df, order))
    total = placed.agg(F.count("*").cast("long").alias("_t"))
    i = F.floor((F.col("idx") * n + F.col("_t") - 1) / F.col("_t"))
    return placed.join(F.broadcast(total)).where((F.col("_t") <= n) | ((F.expr(f"(idx * {n}L + _t - 1) div _t * _t div {n}L") == F.col("idx")) & (i < n))).drop("_t", "before")


@query("wn1_stride_sample", "o AS (SELECT object_id, row_number() OVER (ORDER BY object_id) - 1 AS idx, count(*) OVER () AS t FROM objects) SELECT object_id, idx FROM o WHERE idx IN (SELECT i * t // 37 FROM (SELECT unnest(range(37)) AS i), (SELECT any_value(t) AS t FROM o))")
def wn1(spark, d):
    return stride_sample(fx.objects(spark, d).select("object_id"), ["object_id"], 37)


def walk(members: DataFrame, sub_members: DataFrame) -> DataFrame:
    """(aggregate_idx, segment_index, sub_piece_cid, n, before): each segment with the places [before, before + n) that its source ids have in the walk over all memberships, which itself isn't spelled out."""
    return global_prefix(sized_segments(members, sub_members), ["aggregate_idx", "segment_index"], F.col("n")).drop("idx")


def _at_places(hit: DataFrame, sub_members: DataFrame) -> DataFrame:
    """hit (aggregate_idx, sub_piece_cid, before, idx) with the source id at each place: (aggregate_idx, member_cid, idx)."""
    of = cut(hit.select("aggregate_idx", "sub_piece_cid", (F.col("idx") - F.col("before")).alias("nth"), "idx"))
    some = sub_members.join(of.select("sub_piece_cid").distinct(), "sub_piece_cid", "left_semi")
    return numbered_members(some).join(of, ["sub_piece_cid", "nth"]).select("aggregate_idx", "member_cid", "idx")


def _multiples(i0, i1, place, count: int):
    """Places of the multiples i0 to i1 that lie in a segment; bounds may be one too wide."""
    each = F.transform(F.sequence(F.greatest(i0.cast("long"), F.lit(0)), F.greatest(F.least(i1.cast("long"), F.lit(count - 1).cast("long")), F.greatest(i0.cast("long"), F.lit(0)))), place)
    return F.filter(each, lambda x: (x >= F.col("before")) & (x < F.col("before") + F.col("n")))


def nested_sample(segments: DataFrame, sub_members: DataFrame, population: int, n: float) -> DataFrame:
    """(aggregate_idx, member_cid, idx) at floor(i * population / n) of the walk over all memberships, i in 0..n-1, by a step that is a fraction; n is cut to a whole number.

    population counts distinct members, so where one belongs to several
    aggregates the walk ends before the last of them. All of the population is
    taken if n isn't less. Each segment of the walk (as walk gives them) finds
    the multiples that fall on it, so neither the walk nor the targets travel.
    """
    whole = n != n or n in (float("inf"), float("-inf")) or n >= population
    count = population if whole else max(0, int(n))
    if not count:
        return _at_places(segments.where("false").withColumn("idx", F.col("before")), sub_members)
    step = population / count
    at = lambda i: F.floor(i * F.lit(step)).cast("long")
    places = _multiples(F.floor(F.col("before") / step) - 1, F.ceil((F.col("before") + F.col("n")) / step) + 1, at, count)
    return _at_places(segments.where(F.col("before") <= F.lit(population)).withColumn("idx", F.explode(places)), sub_members)


def n_members(segments: DataFrame, sub_members: DataFrame) -> int:
    """How many distinct source ids the segments hold."""
    return sub_members.join(segments.select("sub_piece_cid").distinct(), "sub_piece_cid", "left_semi").agg(F.countDistinct("member_cid")).first()[0]


def stride_members(segments: DataFrame, sub_members: DataFrame, n: int) -> DataFrame:
    """(aggregate_idx, member_cid, idx) at floor(i * total / n) of the walk over all memberships, i in 0..n-1; all of it where n isn't less. segments is a table that is read twice."""
    total = segments.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = min(n, total)
    if not count:
        return _at_places(segments.where("false").withColumn("idx", F.col("before")), sub_members)
    at = lambda i: F.call_function("div", i * F.lit(total).cast("long"), F.lit(count).cast("long"))
    places = _multiples(F.floor(F.col("before") * count / total) - 1, F.ceil((F.col("before") + F.col("n")) * count / total) + 1, at, count)
    return _at_places(segments.withColumn("idx", F.explode(places)), sub_members)


_WALK = "o AS (SELECT aggregate_idx, member_cid, row_number() OVER (ORDER BY aggregate_idx, segment_index, member_sort_order) - 1 AS idx FROM aggregate_members JOIN sub_piece_members USING (sub_piece_cid) WHERE aggregate_idx IN (SELECT root FROM ledger)), p AS (SELECT count(DISTINCT member_cid) AS n FROM o)"


@query("wn2_stride_sample_members", f"{_WALK} SELECT aggregate_idx, member_cid, idx FROM o JOIN (SELECT CAST(floor(i * (p.n::DOUBLE / least(25, p.n))) AS BIGINT) AS idx FROM p, (SELECT unnest(range(25)) AS i) AS r WHERE i < least(25, p.n)) AS t USING (idx)")
def wn2(spark, d):
    on = fx.ledger(spark, d).select(F.col("root").alias("aggregate_idx"))
    members, sub_members = fx.aggregate_members(spark, d).join(on, "aggregate_idx", "left_semi"), cut(fx.sub_piece_members(spark, d))
    segments = cut(walk(members, sub_members))
    return nested_sample(segments, sub_members, n_members(segments, sub_members), 25.9)


@query("wn2_stride_sample_members_whole", _WALK.rsplit(", p AS", 1)[0] + ", t AS (SELECT count(*) AS t FROM o) SELECT aggregate_idx, member_cid, idx FROM o WHERE idx IN (SELECT i * t // 25 FROM (SELECT unnest(range(25)) AS i), t)")
def wn2_places(spark, d):
    """The same walk by whole places: its length, not the number of distinct members, is the population."""
    on = fx.ledger(spark, d).select(F.col("root").alias("aggregate_idx"))
    members, sub_members = fx.aggregate_members(spark, d).join(on, "aggregate_idx", "left_semi"), cut(fx.sub_piece_members(spark, d))
    return stride_members(cut(walk(members, sub_members)), sub_members, 25)


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; the least order is found before the shuffle, so a key with many rows is no hot task."""
    rest = [x for x in df.columns if x != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(key, *[F.col(f"_x.{x}").alias(x) for x in rest]).select(*df.columns)


_OK = "SELECT line_no, trim(line) AS id FROM lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')"


def content_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines that aren't blank or comments."""
    t = lines.select("line_no", F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("id"))
    return t.where((F.col("id") != "") & ~F.col("id").startswith("#"))


@query("wn3_dedupe_first", f"SELECT id, min(line_no) AS line_no FROM ({_OK}) GROUP BY id")
def wn3(spark, d):
    return dedupe_first(content_lines(fx.lines(spark, d)).select("id", "line_no"), "id", "line_no")


def reject_samples(rejects: DataFrame, n: int = 5, width: int = 64) -> DataFrame:
    """(line_no, sample, total): the first n rejects by line, cut to width, each with the number of all."""
    total = rejects.agg(F.count("*").alias("total"))
    return rejects.orderBy("line_no").limit(n).join(F.broadcast(total)).select("line_no", F.substring("id", 1, width).alias("sample"), "total")


@query("wn4_reject_samples", f"r AS (SELECT * FROM ({_OK}) WHERE id NOT LIKE 'f0155%') SELECT line_no, id[1:64] AS sample, (SELECT count(*) FROM r) AS total FROM r ORDER BY line_no LIMIT 5")
def wn4(spark, d):
    return reject_samples(content_lines(fx.lines(spark, d)).where("id NOT LIKE 'f0155%'"))


def admit(aggs: DataFrame, cap: int, fees: DataFrame) -> DataFrame:
    """(idx, action): rows in flight resume; of planned rows, the first by idx start while slots are free and the last fee doesn't pause."""
    flight = aggs.agg(F.count_if(F.col("status").isin("submitted", "parked", "add_unconfirmed")).alias("busy"))
    fee = fees.agg((c.fee_level(F.max_by("fee", F.struct("ts", "event_id"))) == "spike").alias("pause"))
    slots = flight.join(F.broadcast(fee)).select(F.when(F.col("pause"), 0).otherwise(F.greatest(F.lit(0), F.lit(cap) - F.col("busy"))).alias("slots"), F.col("busy"), F.col("pause"))
    first = aggs.where("status = 'planned'").orderBy("idx").limit(cap).select("idx", F.row_number().over(Window.orderBy("idx")).alias("n"))  # at most cap rows
    start = first.join(F.broadcast(slots)).where("n <= slots").select("idx", F.lit("start").alias("action"))
    return aggs.where(F.col("status").isin("submitted", "parked", "add_unconfirmed")).select("idx", F.lit("resume").alias("action")).union(start)


@query("wn5_admit", """b AS (SELECT count(*) FILTER (status IN ('submitted','parked','add_unconfirmed')) AS busy FROM aggregates), f AS (SELECT arg_max(fee, event_id) >= 200000 AS pause FROM fees WHERE ts = (SELECT max(ts) FROM fees)), s AS (SELECT CASE WHEN pause THEN 0 ELSE greatest(0, 12100 - busy) END AS slots FROM b, f)
    SELECT idx, 'resume' AS action FROM aggregates WHERE status IN ('submitted','parked','add_unconfirmed') UNION ALL SELECT idx, 'start' FROM (SELECT idx, row_number() OVER (ORDER BY idx) AS n FROM aggregates WHERE status = 'planned'), s WHERE n <= slots AND n <= 12100""")
def wn5(spark, d):
    return admit(fx.aggregates(spark, d), 12100, fx.fees(spark, d))


def stalls(log: DataFrame, gap_s: int) -> DataFrame:
    """log (batch, ts, seq, terminal): readings more than gap_s after the batch's terminal count last rose."""
    w = Window.partitionBy("batch").orderBy("ts", "seq")
    run = F.max("terminal").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = log.withColumn("run", run).withColumn("prev", F.lag("run").over(w))
    rose = F.when(F.col("prev").isNull() | (F.col("run") > F.col("prev")), F.col("ts"))
    return rows.withColumn("last", F.max(rose).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("ts") > F.col("last") + F.expr(f"INTERVAL {gap_s} SECONDS")).select("batch", "seq")


_LOG = "l AS (SELECT key AS batch, ts, seq, count(*) FILTER (kind IN ('committed','failed')) OVER (PARTITION BY key ORDER BY ts, seq) AS terminal FROM lifecycle)"


@query("wn6_stalls", f"{_LOG}, r AS (SELECT *, lag(terminal) OVER (PARTITION BY batch ORDER BY ts, seq) AS prev FROM l), m AS (SELECT *, max(CASE WHEN prev IS NULL OR terminal > prev THEN ts END) OVER (PARTITION BY batch ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS last FROM r) SELECT batch, seq FROM m WHERE ts > last + INTERVAL 43200 SECONDS")
def wn6(spark, d):
    w = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    log = fx.lifecycle(spark, d).select(F.col("key").alias("batch"), "ts", "seq", F.count_if(F.col("kind").isin("committed", "failed")).over(w).alias("terminal"))
    return stalls(log, 43200)


def confirm_timeouts(log: DataFrame, limit_s: int) -> DataFrame:
    """log (tx, ts, done): transactions whose last reading is over limit_s after the first, and none says done."""
    g = log.groupBy("tx").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.bool_or("done").alias("done"))
    return g.where(~F.col("done") & (F.col("b") > F.col("a") + F.expr(f"INTERVAL {limit_s} SECONDS"))).select("tx")


@query("wn7_confirm_timeouts", "l AS (SELECT key * 100 + seq % 60 AS tx, ts, kind = 'committed' AS done FROM lifecycle) SELECT tx FROM l GROUP BY tx HAVING NOT bool_or(done) AND max(ts) > min(ts) + INTERVAL 900 SECONDS")
def wn7(spark, d):
    return confirm_timeouts(fx.lifecycle(spark, d).select((F.col("key") * 100 + F.col("seq") % 60).alias("tx"), "ts", (F.col("kind") == "committed").alias("done")), 900)


def canonical_order(df: DataFrame, key: str, group: str) -> DataFrame:
    """place of each row in bytewise order of its id within its group; a group with most of the rows is many tasks."""
    placed = places_within(df.withColumn("_bytes", F.unhex(key)), [group], ["_bytes", "object_id"])
    return placed.drop("_bytes")


@query("wn8_canonical_order", "SELECT object_id, row_number() OVER (PARTITION BY source ORDER BY digest_hex, object_id) - 1 AS place FROM objects")
def wn8(spark, d):
    return canonical_order(fx.objects(spark, d).select("object_id", "source", "digest_hex"), "digest_hex", "source").select("object_id", "place")


def listing(df: DataFrame, statuses: list[str], key: str) -> DataFrame:
    return df.where(F.col("status").isin(*statuses)).orderBy(key)


@query("wn9_pending", "SELECT cid FROM pieces WHERE status IN ('pending','processing','failed') ORDER BY cid")
def wn9a(spark, d):
    return listing(fx.pieces(spark, d), ["pending", "processing", "failed"], "cid").select("cid")


@query("wn9_failures", "SELECT cid, failure_category FROM pieces WHERE status = 'failed' ORDER BY cid")
def wn9b(spark, d):
    return listing(fx.pieces(spark, d), ["failed"], "cid").select("cid", "failure_category")


@query("wn9_done", "SELECT cid, raw_size FROM pieces WHERE status = 'done' ORDER BY cid")
def wn9c(spark, d):
    return listing(fx.pieces(spark, d), ["done"], "cid").select("cid", "raw_size")


@query("wn9_by_status", "SELECT sub_piece_cid FROM sub_pieces WHERE status = 'built' ORDER BY 1")
def wn9d(spark, d):
    return listing(fx.sub_pieces(spark, d), ["built"], "sub_piece_cid").select("sub_piece_cid")
