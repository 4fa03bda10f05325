"""Set-based lifecycle updates: each returns the whole new state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..registry import query
from .aggregations import first_success, record_outcome  # noqa: F401

#: From which states each kind may follow.
ALLOWED = {"planned": ("failed", "add_unconfirmed"), "submitted": ("planned", "failed"), "parked": ("planned", "submitted"), "add_unconfirmed": ("parked",), "committed": ("parked", "submitted", "add_unconfirmed"), "failed": ("planned", "submitted", "parked", "add_unconfirmed")}


def apply_results(pieces: DataFrame, results: DataFrame) -> DataFrame:
    """pieces with results (cid, ok, new_category): success clears the error and keeps the category, failure sets it."""
    j = pieces.join(results, "cid", "left")
    return j.withColumn("status", F.when(F.col("ok"), "done").when(~F.col("ok"), "failed").otherwise(F.col("status"))).withColumn("failure_category", F.when(~F.col("ok"), F.col("new_category")).otherwise(F.col("failure_category"))).drop("ok", "new_category")


@query("lc1_apply_results", "SELECT cid, CASE WHEN k % 6 = 0 THEN 'done' WHEN k % 6 = 3 THEN 'failed' ELSE status END AS status, CASE WHEN k % 6 = 3 THEN 'oversized' ELSE failure_category END AS failure_category FROM pieces")
def lc1(spark, d):
    p = fx.pieces(spark, d)
    r = p.where("k % 3 = 0").select("cid", (F.col("k") % 6 == 0).alias("ok"), F.lit("oversized").alias("new_category"))
    return apply_results(p, r).select("cid", "status", "failure_category")


def mark_oversized(pieces: DataFrame, cap: int) -> DataFrame:
    """Done pieces above cap become oversized, oversized ones within it done again."""
    over = F.col("raw_size") > cap
    return pieces.withColumn("status", F.when((F.col("status") == "done") & over, "oversized").when((F.col("status") == "oversized") & ~over, "done").otherwise(F.col("status")))


@query("lc2_mark_oversized", "SELECT cid, CASE WHEN status IN ('done','oversized') THEN CASE WHEN raw_size > 5000 THEN 'oversized' ELSE 'done' END ELSE status END AS status FROM pieces")
def lc2(spark, d):
    return mark_oversized(fx.pieces(spark, d), 5000).select("cid", "status")


def reset_pieces(pieces: DataFrame, statuses: tuple[str, ...] = ("processing", "failed")) -> DataFrame:
    return pieces.withColumn("status", F.when(F.col("status").isin(*statuses), "pending").otherwise(F.col("status")))


@query("lc3_reset_pieces", "SELECT cid, CASE WHEN status IN ('processing','failed') THEN 'pending' ELSE status END AS status FROM pieces")
def lc3(spark, d):
    return reset_pieces(fx.pieces(spark, d)).select("cid", "status")


def fold(events: DataFrame) -> DataFrame:
    """(key, status, last_seq, committed_at, n_failed): the last status of each key; a commit is final."""
    return events.groupBy("key").agg(
        F.when(F.bool_or(F.col("kind") == "committed"), "committed").otherwise(F.max_by("kind", "seq")).alias("status"), F.max("seq").alias("last_seq"),
        F.min(F.when(F.col("kind") == "committed", F.col("seq"))).alias("committed_at"), F.count_if(F.col("kind") == "failed").alias("n_failed"),
    )


@query("lc4_fold", "SELECT key, CASE WHEN bool_or(kind = 'committed') THEN 'committed' ELSE arg_max(kind, seq) END AS status, max(seq) AS last_seq, min(seq) FILTER (kind = 'committed') AS committed_at, count(*) FILTER (kind = 'failed') AS n_failed FROM lifecycle GROUP BY key")
def lc4(spark, d):
    return fold(fx.lifecycle(spark, d))


def apply_transitions(aggs: DataFrame, events: DataFrame) -> DataFrame:
    """aggs (idx, status, tx_hash, error, committed_block) after events (idx, seq, kind, tx, error, block) in the order of seq.

    A tx event sets the hash alone. Failures and unconfirmed adds keep the old
    error where they bring none; an unverified commit sets its own and has no
    block; a commit sets hash and block, and leaves the error. Fields that no
    event sets stay as they are; events of unknown idx are passed over.
    """
    kind = F.col("kind")
    commits = kind.isin("committed", "committed_unverified")
    sets = {
        "status": (kind != "tx", F.when(commits, "committed").otherwise(kind)),
        "tx_hash": (commits | (kind == "tx"), F.col("tx")),
        "error": ((kind == "committed_unverified") | (kind.isin("failed", "add_unconfirmed") & F.col("error").isNotNull()), F.col("error")),
        "committed_block": (commits, F.when(kind == "committed", F.col("block"))),
    }
    last = [F.max_by(F.struct(value.alias("v")), F.when(hit, F.col("seq"))).alias(f"_{name}") for name, (hit, value) in sets.items()]
    joined = aggs.join(events.groupBy("idx").agg(*last), "idx", "left")
    return joined.select(*[F.when(F.col(f"_{n}").isNotNull(), F.col(f"_{n}")["v"]).otherwise(F.col(n)).alias(n) if n in sets else F.col(n) for n in aggs.columns])


_MARKS = """m AS (SELECT key * 7 + seq % 7 AS idx, seq, CASE WHEN kind = 'planned' THEN CASE WHEN seq % 2 = 0 THEN 'tx' ELSE 'add_unconfirmed' END WHEN kind = 'committed' AND seq % 3 = 0 THEN 'committed_unverified' ELSE kind END AS kind, CASE WHEN seq % 5 <> 0 THEN '0x' || seq END AS tx, CASE WHEN seq % 4 <> 0 THEN 'e' || seq END AS error, seq * 2 AS block FROM lifecycle)"""


@query("lc4_transitions", f"""{_MARKS}, e AS (SELECT idx, arg_max({{'v': CASE WHEN kind LIKE 'committed%' THEN 'committed' ELSE kind END}}, seq) FILTER (kind <> 'tx') AS s, arg_max({{'v': tx}}, seq) FILTER (kind = 'tx' OR kind LIKE 'committed%') AS t,
    arg_max({{'v': error}}, seq) FILTER (kind = 'committed_unverified' OR (kind IN ('failed','add_unconfirmed') AND error IS NOT NULL)) AS r, arg_max({{'v': CASE WHEN kind = 'committed' THEN block END}}, seq) FILTER (kind LIKE 'committed%') AS b FROM m GROUP BY idx)
    SELECT a.idx, CASE WHEN s IS NULL THEN status ELSE s.v END AS status, CASE WHEN t IS NULL THEN tx_hash ELSE t.v END AS tx_hash, CASE WHEN r IS NULL THEN a.error ELSE r.v END AS error, CASE WHEN b IS NOT NULL THEN b.v END AS committed_block FROM aggregates a LEFT JOIN e ON a.idx = e.idx""")
def lc4_transitions(spark, d):
    seq, kind = F.col("seq"), F.col("kind")
    marked = F.when(kind == "planned", F.when(seq % 2 == 0, "tx").otherwise("add_unconfirmed")).when((kind == "committed") & (seq % 3 == 0), "committed_unverified").otherwise(kind)
    text = lambda head: F.concat(F.lit(head), seq.cast("string"))
    events = fx.lifecycle(spark, d).select((F.col("key") * 7 + seq % 7).alias("idx"), "seq", marked.alias("kind"), F.when(seq % 5 != 0, text("0x")).alias("tx"), F.when(seq % 4 != 0, text("e")).alias("error"), (seq * 2).alias("block"))
    return apply_transitions(fx.aggregates(spark, d).withColumn("committed_block", F.lit(None).cast("long")), events)


def reset_aggregates(aggs: DataFrame, unconfirmed: bool) -> DataFrame:
    """Failed aggregates to planned with their tx kept; or unconfirmed ones with theirs cleared. Both clear the error; neither touches the other's rows."""
    hit = F.col("status").eqNullSafe("add_unconfirmed" if unconfirmed else "failed")
    cleared = ["error", "tx_hash"] if unconfirmed else ["error"]
    out = aggs.withColumns({name: F.when(~hit, F.col(name)) for name in cleared})
    return out.withColumn("status", F.when(hit, "planned").otherwise(F.col("status")))


@query("lc5_reset_unconfirmed", "SELECT idx, CASE WHEN status = 'add_unconfirmed' THEN 'planned' ELSE status END AS status, CASE WHEN status = 'add_unconfirmed' THEN NULL ELSE tx_hash END AS tx_hash FROM aggregates")
def lc5(spark, d):
    a = fx.aggregates(spark, d)
    return reset_aggregates(a, True).select("idx", "status", "tx_hash")


@query("lc5_reset_failed", f"""{_MARKS}, f AS (SELECT idx, arg_max(kind, seq) AS status, max(seq) AS last FROM m WHERE kind <> 'tx' GROUP BY idx) SELECT idx, CASE WHEN status = 'failed' THEN 'planned' ELSE status END AS status, '0x' || last AS tx_hash, CASE WHEN status <> 'failed' THEN 'e' || last END AS error FROM f""")
def lc5_reset_failed(spark, d):
    """Failed rows re-armed: their hash stays, their error goes, and unconfirmed rows keep both."""
    seq, kind = F.col("seq"), F.col("kind")
    marked = F.when(kind == "planned", F.when(seq % 2 != 0, "add_unconfirmed")).when((kind == "committed") & (seq % 3 == 0), "committed_unverified").otherwise(kind)
    last = fx.lifecycle(spark, d).select((F.col("key") * 7 + seq % 7).alias("idx"), "seq", marked.alias("kind")).where("kind IS NOT NULL").groupBy("idx").agg(F.max_by("kind", "seq").alias("status"), F.max("seq").cast("string").alias("last"))
    return reset_aggregates(last.select("idx", "status", F.concat(F.lit("0x"), "last").alias("tx_hash"), F.concat(F.lit("e"), "last").alias("error")), False)


def attempt_log(events: DataFrame) -> DataFrame:
    """(attempt, started, result, n): start and result rows of each attempt folded into one."""
    return events.groupBy("attempt").agg(F.min("ts").alias("started"), F.max_by("kind", "seq").alias("result"), F.count("*").alias("n"))


@query("lc6_attempt_log", "SELECT key * 1000 + seq % 7 AS attempt, min(ts) AS started, arg_max(kind, seq) AS result, count(*) AS n FROM lifecycle GROUP BY 1")
def lc6(spark, d):
    return attempt_log(fx.lifecycle(spark, d).select((F.col("key") * 1000 + F.col("seq") % 7).alias("attempt"), "ts", "kind", "seq"))


def unknown_members(members: DataFrame, pieces: DataFrame) -> DataFrame:
    """Members that no piece has; a save with any is refused (sources.state.save_sub_pieces)."""
    return members.select("member_cid").distinct().join(pieces.select(F.col("cid").alias("member_cid")), "member_cid", "left_anti")


@query("lc7_unknown_members", "SELECT DISTINCT member_cid FROM sub_piece_members WHERE member_cid NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 <> 0)")
def lc7(spark, d):
    return unknown_members(fx.sub_piece_members(spark, d), fx.read(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("cid")))


def upgrade_records(records: DataFrame, n: int) -> DataFrame:
    """(ctx, tx, chunks): a record with a transaction gets one confirm-only chunk, others are cut into chunks of n."""
    cut_up = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("piece_ids") - 1) / n), F.lit(0)).cast("int")), lambda i: F.slice("piece_ids", i * n + 1, F.lit(n)))
    return records.select("ctx", "chunk", F.when(F.col("tx").isNotNull(), F.array("piece_ids")).otherwise(cut_up).alias("chunks"))


@query("lc8_upgrade_records", "SELECT ctx, chunk, CASE WHEN tx IS NOT NULL THEN [piece_ids] ELSE list_transform(range(0, (len(piece_ids) + 1) // 2), lambda i: piece_ids[i * 2 + 1:i * 2 + 2]) END AS chunks FROM chunks")
def lc8(spark, d):
    return upgrade_records(fx.chunks(spark, d), 2)


def lookup(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each requested key with its row, nulls where there is none."""
    return keys.select(key).join(table, key, "left")


@query("lc9_lookup", "SELECT k AS sub_piece_cid, raw_size, url FROM (SELECT DISTINCT l_partkey + 1990 AS k FROM lineitem) LEFT JOIN sub_pieces ON k = sub_piece_cid")
def lc9(spark, d):
    keys = fx.read(spark, d, "lineitem").select((F.col("l_partkey") + 1990).alias("sub_piece_cid")).distinct()
    return lookup(keys, fx.sub_pieces(spark, d).select("sub_piece_cid", "raw_size", "url"), "sub_piece_cid")
