"""Rounds of an advance over the state: each decides from one version, what others report, and publishes the next one; a round that was published already changes nothing."""

from __future__ import annotations



from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import columns as c
from ..operators import joins
from ..operators.aggregations import batch_outcome
from ..operators.lifecycle import apply_transitions
from ..operators.packing import PADDED_SQL, batches
from ..operators.rows import below_floor
from ..operators.windows import admit
from ..registry import query
from ..sources.state import State
from .primitives import cut

#: Sub-pieces of a pull batch.
BATCH = 32


def pull_batches(members: DataFrame, pulls: DataFrame, size: int) -> DataFrame:
    """(aggregate_idx, batch, ids, terminal, n_ok, n_failed) of members in order, cut into batches; pulls (sub_piece_cid, state) says complete or failed, anything else is under way."""
    cut_up = batches(members, size)
    name = F.struct("aggregate_idx", "batch")
    each = cut_up.select(name.alias("batch"), F.explode("ids").alias("sub_piece_cid")).join(pulls, "sub_piece_cid", "left")
    state = F.when(F.col("state") == "complete", "committed").when(F.col("state") == "failed", "failed").otherwise("running")
    outcome = batch_outcome(each.select("batch", state.alias("state"))).select("batch.aggregate_idx", "batch.batch", "terminal", "n_ok", "n_failed")
    return cut_up.join(outcome, ["aggregate_idx", "batch"])


def decide(aggs: DataFrame, members: DataFrame, sizes: DataFrame, cap: int, fees: DataFrame, ledger: DataFrame, events: DataFrame, pulls: DataFrame, adds: DataFrame, floor: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(marks (idx, seq, kind, tx, error, block), batches pulled) of one round.

    Admitted aggregates with a transaction, or on the ledger, are committed,
    wait or are held, and never added again. Others are pulled: refused where a
    sub-piece (sizes: sub_piece_cid, raw_size) is below the floor, failed where a
    pull failed, parked once all are there. Parked ones get the transaction of
    their add (adds: idx, tx).
    """
    admitted = cut(admit(aggs, cap, fees).join(aggs, "idx"))
    decided = cut(joins.resume_decision(admitted, ledger, events).join(admitted.select("idx", "status", "tx_hash"), "idx"))
    go = decided.where("decision = 'proceed' AND status <> 'parked'")
    held = members.join(go.select(F.col("idx").alias("aggregate_idx")), "aggregate_idx", "left_semi")
    small = below_floor(held.join(sizes, "sub_piece_cid"), floor).groupBy(F.col("aggregate_idx").alias("idx")).agg(F.count("*").alias("n_small"))
    refused = cut(go.where("status = 'planned'").join(small, "idx").select("idx", "n_small"))
    pulled = cut(pull_batches(held.join(refused.select(F.col("idx").alias("aggregate_idx")), "aggregate_idx", "left_anti"), pulls, size))
    ends = pulled.groupBy(F.col("aggregate_idx").alias("idx")).agg(F.bool_and("terminal").alias("terminal"), F.sum("n_failed").alias("n_failed"))
    ran = go.join(refused.select("idx"), "idx", "left_anti").join(ends, "idx", "left").withColumn("n_failed", F.coalesce("n_failed", F.lit(0)))
    mark = lambda kind, tx=None, error=None: [F.lit(0).alias("seq"), kind.alias("kind"), (F.lit(None) if tx is None else F.col(tx)).cast("string").alias("tx"), (F.lit(None) if error is None else error).cast("string").alias("error"), F.lit(None).cast("long").alias("block")]
    kind = F.when(~F.coalesce("terminal", F.lit(True)), "submitted").when(F.col("n_failed") > 0, "failed").otherwise("parked")
    marks = [
        refused.select("idx", *mark(F.lit("failed"), error=F.concat("n_small", F.lit(f" sub-pieces are below the floor of {floor}")))),
        ran.select("idx", *mark(kind, error=F.when(kind == "failed", F.concat(F.lit("pull failed for "), "n_failed", F.lit(" sub-pieces"))))),
        decided.where("decision = 'proceed' AND status = 'parked'").join(adds, "idx").select("idx", *mark(F.lit("tx"), tx="tx")),
        decided.where("decision = 'commit'").select("idx", *mark(F.lit("committed"), tx="tx_hash")),
        decided.where("decision = 'commit_unverified'").select("idx", *mark(F.lit("committed_unverified"), tx="tx_hash", error=F.lit("on the ledger, but its event doesn't list it"))),
        decided.where("decision = 'already_on_ledger'").select("idx", *mark(F.lit("committed_unverified"), tx="tx_hash", error=F.lit("on the ledger before it was added"))),
    ]
    out = marks[0]
    for more in marks[1:]:
        out = out.unionByName(more)
    return out, pulled


def run_round(state: State, version: int, number: int, cap: int, fees: DataFrame, ledger: DataFrame, events: DataFrame, pulls: DataFrame, adds: DataFrame, floor: int = 0, size: int = BATCH) -> int:
    """The version after round `number`: marks applied, pulled batches in the log and the round's totals. If the state has that round already, nothing changes."""
    if not state.table("rounds", version).where(F.col("round") == number).isEmpty():
        return version
    aggs, members = state.table("aggregates", version), state.table("aggregate_members", version)
    sizes = state.table("sub_pieces", version).select("sub_piece_cid", "raw_size")
    marks, pulled = decide(aggs, members, sizes, cap, fees, ledger, events, pulls, adds, floor, size)
    marks = cut(marks)
    committed = marks.where("kind LIKE 'committed%'").select("idx")
    bytes_of = members.join(committed.select(F.col("idx").alias("aggregate_idx")), "aggregate_idx", "left_semi").join(sizes, "sub_piece_cid")
    totals = marks.agg(F.lit(number).alias("round"), F.count("*").alias("marked"), F.count_if(F.col("kind").startswith("committed")).alias("committed"), F.count_if(F.col("kind") == "failed").alias("failed"))
    totals = totals.join(F.broadcast(bytes_of.agg(F.coalesce(F.sum("raw_size"), F.lit(0)).alias("bytes"))))  # one row each
    log = pulled.select(F.xxhash64(F.lit(number), "aggregate_idx", "batch").alias("attempt"), "aggregate_idx", "batch", F.col("ids").alias("piece_cids"), F.lit(None).cast("timestamp").alias("started"), F.concat_ws("/", "n_ok", "n_failed").alias("result"))
    return state.publish(version, replace={"aggregates": apply_transitions(aggs, marks)}, append={"pull_batch_attempts": log, "rounds": totals})


_CAP, _FLOOR, _SIZE = 1000, 1 << 21, 3
_FACTS = f"""w AS MATERIALIZED (SELECT aggregate_idx AS idx, count(*) AS n, count(*) FILTER ({PADDED_SQL} < {_FLOOR}) AS n_small, count(*) FILTER (sub_piece_cid % 23 = 0) AS n_failed, count(*) FILTER (sub_piece_cid % 29 = 1) AS n_running FROM aggregate_members JOIN sub_pieces USING (sub_piece_cid) GROUP BY 1),
    ev AS (SELECT tx, roots FROM added_events), pa AS (SELECT arg_max(fee, event_id) >= {c.MAX_FEE} AS pause FROM fees WHERE ts = (SELECT max(ts) FROM fees)), s0 AS (SELECT idx, status, tx_hash, error, 0::BIGINT AS n_batches FROM aggregates)"""


def _round_sql(k: int) -> str:
    """CTE s{k}: the aggregates after round k, from s{k - 1}."""
    busy = "status IN ('submitted','parked','add_unconfirmed')"
    return f"""b{k} AS (SELECT CASE WHEN pause THEN 0 ELSE greatest(0, {_CAP} - (SELECT count(*) FROM s{k - 1} WHERE {busy})) END AS slots FROM pa),
    g{k} AS (SELECT idx FROM s{k - 1} WHERE {busy} UNION ALL SELECT idx FROM (SELECT idx, row_number() OVER (ORDER BY idx) AS i FROM s{k - 1} WHERE status = 'planned'), b{k} WHERE i <= slots),
    d{k} AS (SELECT idx, CASE WHEN tx_hash IS NOT NULL THEN CASE WHEN root IS NULL THEN 'wait' WHEN coalesce(list_contains(roots, idx), false) THEN 'commit' ELSE 'commit_unverified' END WHEN status = 'add_unconfirmed' THEN CASE WHEN root IS NULL THEN 'hold' ELSE 'commit' END WHEN root IS NOT NULL THEN 'already_on_ledger' ELSE 'proceed' END AS decision
        FROM g{k} JOIN s{k - 1} USING (idx) LEFT JOIN ledger ON idx = root LEFT JOIN ev ON tx = tx_hash),
    k{k} AS (SELECT idx, s.status, tx_hash, error, n_batches, coalesce(n, 0) AS n, n_small, coalesce(n_failed, 0) AS n_failed, CASE WHEN decision LIKE 'commit%' OR decision = 'already_on_ledger' THEN decision WHEN decision = 'proceed' THEN CASE WHEN status = 'parked' THEN 'tx' WHEN status = 'planned' AND coalesce(n_small, 0) > 0 THEN 'small' WHEN coalesce(n_running, 0) > 0 THEN 'submitted' WHEN coalesce(n_failed, 0) > 0 THEN 'failed' ELSE 'parked' END END AS act FROM s{k - 1} AS s LEFT JOIN d{k} USING (idx) LEFT JOIN w USING (idx)),
    s{k} AS MATERIALIZED (SELECT idx, CASE WHEN act IN ('commit', 'commit_unverified', 'already_on_ledger') THEN 'committed' WHEN act = 'small' THEN 'failed' WHEN act IN ('submitted', 'failed', 'parked') THEN act ELSE status END AS status, CASE WHEN act = 'tx' AND idx % 2 = 0 THEN '0xadd' || idx ELSE tx_hash END AS tx_hash,
        CASE act WHEN 'small' THEN n_small || ' sub-pieces are below the floor of {_FLOOR}' WHEN 'failed' THEN 'pull failed for ' || n_failed || ' sub-pieces' WHEN 'commit_unverified' THEN 'on the ledger, but its event doesn''t list it' WHEN 'already_on_ledger' THEN 'on the ledger before it was added' ELSE error END AS error,
        n_batches + CASE WHEN act IN ('submitted', 'failed', 'parked') THEN (n + {_SIZE - 1}) // {_SIZE} ELSE 0 END AS n_batches FROM k{k})"""


@query("job7_two_rounds", f"{_FACTS}, {_round_sql(1)}, {_round_sql(2)} SELECT * FROM s2")
def job7_two_rounds(spark, d):
    """Two rounds over the published state, the first of them run twice: every aggregate after them, and how many batches were pulled for it."""
    from .jobs import first_state

    placed = cut(fx.aggregate_members(spark, d))  # lines are sorted once, for the state and for the events that both rounds ask
    events = cut(fx.added_events(spark, d, placed).select("tx", "roots"))
    state = first_state(spark, d, placed)
    state.publish(1, replace={"pull_batch_attempts": state.table("pull_batch_attempts", 1).limit(0)})
    sub = F.col("sub_piece_cid")
    k = sub.cast("long")
    pulls = state.table("sub_pieces").select(sub, F.when(k % 29 == 1, "pending").when(k % 23 == 0, "failed").otherwise("complete").alias("state"))
    adds = state.table("aggregates").where("idx % 2 = 0").select("idx", F.concat(F.lit("0xadd"), "idx").alias("tx"))
    says = (_CAP, fx.fees(spark, d), fx.ledger(spark, d), events, pulls, adds, _FLOOR, _SIZE)
    version = 2
    for number in (1, 1, 2):
        version = run_round(state, version, number, *says)
    if version != 4:
        raise AssertionError("a repeated round was published")
    n = state.table("pull_batch_attempts").groupBy(F.col("aggregate_idx").alias("idx")).agg(F.count("*").alias("n_batches"))
    return state.table("aggregates").join(n, "idx", "left").select("idx", "status", "tx_hash", "error", F.coalesce("n_batches", F.lit(0)).alias("n_batches"))
