"""Structured Streaming jobs, each compared with its batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixtures as fx
from ..functions import columns as c
from ..operators.intake import canonical_stream
from ..operators.joins import files_of, resolve_requests
from ..operators.lifecycle import ALLOWED
from ..operators.packing import PADDED_SQL, append_aggregates
from ..operators.windows import content_lines
from ..plans.primitives import shared_dir
from ..registry import query


def as_stream(df: DataFrame, order: str, slices: int = 4, slice_of: Column | None = None, files: int = 4) -> DataFrame:
    """df as a stream of slices in order, one a trigger, each written by as many tasks as it has files; slice_of numbers the slices from 0 where their bounds matter."""
    path = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    if slice_of is None:
        cuts = df.approxQuantile(order, [i / slices for i in range(1, slices)], 0.01)
        slice_of = reduce(lambda n, cut: n + (F.col(order) > cut).cast("int"), cuts, F.lit(0))
    sliced = df.withColumn("_slice", slice_of)
    counts = {r["_slice"]: r["count"] for r in sliced.groupBy("_slice").count().collect()}  # one row for each slice
    # Every slice has the same number of files, none of them empty, so that a trigger is a slice.
    files = files if min(counts.values(), default=0) >= 4 * files else 1
    for k in sorted(counts):  # one after another: files are read in order of their age
        sliced.where(F.col("_slice") == k).drop("_slice").repartition(files).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """What a stream emits until its source is used up, with the trigger that emitted it (_batch)."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # state with timers needs it
    base = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/rows/b={batch}")  # a repeated batch replaces itself

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(each or write).start()
    q.awaitTermination()
    if each is not None:
        return stream.sparkSession.createDataFrame([], "b int")
    schema = stream.select("*", F.lit(0).alias("_batch")).schema
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/rows")


def bucketed(events: DataFrame, name: str) -> DataFrame:
    """events with the bucket of their id: 256 neighbouring ids at most share one call and one value of the state."""
    return events.withColumn("bucket", F.shiftright(name, 8))


class LifecycleFold(StatefulProcessor):
    """The status of each key of a bucket, and every transition that isn't allowed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "key array<long>, status array<string>, last_seq array<long>, n_illegal array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k: now for k, *now in zip(*self.state.get())} if self.state.exists() else {}
        out, touched = [], set()
        ids = lambda pdf: [None] * len(pdf) if pd.isna(key[0]) else pdf["key"].tolist()  # noqa: E731  # the bucket without a number has the rows without a key
        for k, seq, kind in sorted(r for pdf in rows for r in zip(ids(pdf), pdf["seq"].tolist(), pdf["kind"])):
            status, last, bad = held.get(k, (None, -1, 0))
            if status is not None and status not in ALLOWED[kind]:
                bad += 1
                out.append((k, seq, status, kind, None, None))
            held[k] = ["committed" if status == "committed" else kind, max(last, seq), bad]
            touched.add(k)
        self.state.update((list(held), *(list(x) for x in zip(*held.values()))))
        out += [(k, held[k][1], None, None, held[k][0], held[k][2]) for k in touched]
        yield pd.DataFrame(out, columns=["key", "seq", "before", "kind", "status", "n_illegal"]).astype({"key": "Int64", "n_illegal": "Int64"})

    def close(self) -> None:
        pass


def lifecycle_fold(events: DataFrame) -> DataFrame:
    """After each trigger, for the keys it touched: (key, seq, status, n_illegal) as of its last event, and for each transition that isn't allowed (key, seq, before, kind)."""
    return bucketed(events, "key").groupBy("bucket").transformWithStateInPandas(LifecycleFold(), "key long, seq long, before string, kind string, status string, n_illegal long", "Update", "None")


_STEPS = f"""t AS (SELECT key, seq, kind, CASE WHEN max(CASE WHEN kind = 'committed' THEN 1 END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'committed' ELSE lag(kind) OVER (PARTITION BY key ORDER BY seq) END AS before FROM lifecycle),
    x AS (SELECT *, before IS NOT NULL AND NOT CASE kind {" ".join(f"WHEN '{kind}' THEN before IN ({', '.join(repr(k) for k in allowed)})" for kind, allowed in ALLOWED.items())} END AS illegal FROM t)"""


@query("st1_lifecycle_fold", f"{_STEPS} SELECT key, CASE WHEN bool_or(kind = 'committed') THEN 'committed' ELSE arg_max(kind, seq) END AS status, max(seq) AS last_seq, count(*) FILTER (illegal) AS n_illegal FROM x GROUP BY key")
def st1(spark, d):
    out = drain(lifecycle_fold(as_stream(fx.lifecycle(spark, d).select("key", "seq", "kind"), "seq")).where("status IS NOT NULL"), "update")
    return out.groupBy("key").agg(F.max_by("status", "_batch").alias("status"), F.max("seq").alias("last_seq"), F.max_by("n_illegal", "_batch").alias("n_illegal"))


@query("st1_illegal_transitions", f"{_STEPS} SELECT key, seq, before, kind FROM x WHERE illegal")
def st1_illegal(spark, d):
    return drain(lifecycle_fold(as_stream(fx.lifecycle(spark, d).select("key", "seq", "kind"), "seq")).where("status IS NULL"), "update").select("key", "seq", "before", "kind")


class StallWatchdog(StatefulProcessor):
    """Alarms of a bucket of batches: each time of progress after which none comes within the gap.

    Times within a gap of the next one raise none, so runs of such times are
    kept as (start, last) until the watermark has passed the gap after their
    last; one timer a bucket waits for the first of these.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "batch array<long>, begun array<long>, open array<boolean>, of array<long>, start array<long>, last array<long>, timer long")

    def _load(self) -> tuple[dict[int, tuple[int, bool]], dict[int, list[tuple[int, int]]], int | None]:
        """(first time, whether it is to be judged) of each batch, its runs in order, and the timer that is set."""
        batch, begun, still, of, start, last, timer = self.state.get() if self.state.exists() else ([],) * 6 + (None,)
        runs: dict[int, list[tuple[int, int]]] = {}
        for k, *run in zip(of, start, last):
            runs.setdefault(k, []).append(tuple(run))
        return {k: (t, o) for k, t, o in zip(batch, begun, still)}, runs, timer

    def _save(self, first: dict[int, tuple[int, bool]], runs: dict[int, list[tuple[int, int]]], timer: int | None) -> None:
        ends = [*(t for t, still in first.values() if still), *(last for found in runs.values() for _, last in found)]
        due = min(ends) + self.gap_ms + 1 if ends else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        flat = [(k, *run) for k, found in runs.items() for run in found]
        self.state.update((list(first), [t for t, _ in first.values()], [o for _, o in first.values()], *([r[i] for r in flat] for i in range(3)), due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, runs, timer = self._load()
        for pdf in rows:
            at = pdf["ts"].astype("int64") // {"ns": 10**6, "us": 10**3, "ms": 1}[pdf["ts"].dt.unit]
            batch = pdf["batch"].fillna(0)  # a bucket has rows without a batch or with one, never both
            for k, lowest in at.groupby(batch).min().items():
                if k not in first or lowest < first[k][0]:
                    first[int(k)] = (int(lowest), True)
            rose = pdf["kind"].isin(["committed", "failed"])
            for k, times in at[rose].groupby(batch[rose]):
                found: list[tuple[int, int]] = []
                for start, last in sorted([*runs.get(k, []), *((t, t) for t in times.tolist())]):
                    if found and start - found[-1][1] <= self.gap_ms:
                        found[-1] = (found[-1][0], max(last, found[-1][1]))
                    else:
                        found.append((start, last))
                runs[int(k)] = found
        self._save(first, runs, timer)
        yield pd.DataFrame({"batch": pd.Series([], dtype="int64"), "since": pd.Series([], dtype="datetime64[us]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, runs, timer = self._load()
        over = timerValues.getCurrentWatermarkInMs() - self.gap_ms  # what is earlier has had its gap
        alarms = []
        for k, (t, still) in first.items():
            if still and t < over:
                first[k] = (t, False)
                # The first time itself may be one of progress; a run is judged no earlier than the first time before it.
                if not any(start <= t + self.gap_ms for start, _ in runs.get(k, ())):
                    alarms.append((k, t))
        for k, found in list(runs.items()):
            alarms += [(k, last) for _, last in found if last < over]
            runs[k] = [run for run in found if run[1] >= over]
            if not runs[k]:
                del runs[k]
        self._save(first, runs, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        yield pd.DataFrame({"batch": pd.Series([None if pd.isna(key[0]) else k for k, _ in alarms], dtype="Int64"), "since": pd.to_datetime([t for _, t in alarms], unit="ms").as_unit("us")})

    def close(self) -> None:
        pass


def stall_watchdog(events: DataFrame, gap_s: int, late: str = "10 minutes") -> DataFrame:
    """(batch, since) when event time has passed gap_s after the batch's first event, or after one that committed or failed, without one such in between; later events are dropped past the watermark."""
    return bucketed(events.withWatermark("ts", late), "batch").groupBy("bucket").transformWithStateInPandas(StallWatchdog(gap_s * 1000), "batch long, since timestamp", "Append", "EventTime")


@query("st2_stall_watchdog", """e AS (SELECT key AS batch, epoch_us(ts) // 1000 AS m, kind IN ('committed', 'failed') AS rose FROM lifecycle), p AS (SELECT DISTINCT batch, m FROM e WHERE rose UNION SELECT batch, min(m) FROM e GROUP BY batch),
    n AS (SELECT p.batch, p.m, min(e.m) AS following FROM p LEFT JOIN e ON e.batch = p.batch AND e.rose AND e.m > p.m GROUP BY 1, 2) SELECT batch, make_timestamp(m * 1000) AS since FROM n WHERE following IS NULL OR following > m + 43200000""")
def st2(spark, d):
    """Batches without progress for half a day; a last event far ahead lets all timers expire. The slices of this replay overlap in time, hence the wide watermark."""
    e = fx.lifecycle(spark, d).select(F.col("key").alias("batch"), F.col("ts").cast("timestamp").alias("ts"), "kind", "seq")
    end = e.agg(F.max("ts").alias("t"), F.max("seq").alias("s")).select(F.lit(-1).cast("long").alias("batch"), (F.col("t") + F.expr("INTERVAL 120 DAYS")).alias("ts"), F.lit("planned").alias("kind"), (F.col("s") + 1).alias("seq"))
    out = drain(stall_watchdog(as_stream(e.union(end), "seq"), 43200, "60 days"))
    return out.where("batch >= 0").select("batch", F.col("since").cast("timestamp_ntz").alias("since"))


@query("st3_resolve_requests", r"""q AS (SELECT req_id, CAST(path[8:] AS BIGINT) AS piece FROM requests WHERE regexp_matches(path, '^/piece/[0-9]{1,18}$'))
    SELECT req_id, CASE WHEN s.status IS NULL OR s.status <> 'built' OR (car_path IS NOT NULL AND sub_piece_cid % 5 = 0) THEN 404 WHEN car_path IS NOT NULL AND sub_piece_cid % 7 = 0 THEN 500 WHEN car_path IS NOT NULL THEN 200 ELSE 302 END AS status FROM q LEFT JOIN sub_pieces s ON piece = sub_piece_cid""")
def st3(spark, d):
    """Requests as a stream against the static sub-piece table."""
    q = as_stream(fx.requests(spark, d), "req_id").select("req_id", c.piece_of_path(F.col("path")).alias("piece")).where("piece IS NOT NULL")
    s = fx.sub_pieces(spark, d)
    return drain(resolve_requests(q, s, files_of(s))).select("req_id", "status")


@query("st4_fee_monitor", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, count(*) FILTER (fee >= 200000) AS spikes, max(fee) AS highest FROM fees GROUP BY 1")
def st4(spark, d):
    """Fee readings by day; days close once the watermark has passed them, so a last reading far ahead closes them all. The files of this replay arrive in any order, hence the wide watermark."""
    f = fx.fees(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "fee")
    end = f.agg(F.max("event_id").alias("m"), F.max("ts").alias("t")).select((F.col("m") + 1).alias("event_id"), (F.col("t") + F.expr("INTERVAL 90 DAYS")).alias("ts"), F.lit(-1).cast("decimal(38,0)").alias("fee"))
    s = as_stream(f.union(end), "event_id").withWatermark("ts", "60 days").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.count_if(c.fee_level(F.col("fee")) == "spike").alias("spikes"), F.max("fee").alias("highest"))
    return drain(s).where("highest >= 0").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "spikes", "highest")


def incremental_plan(spark: SparkSession, stream: DataFrame, path: str, cap: int) -> None:
    """Appends aggregates over each trigger's new sub-pieces, numbered above those before; what was planned once stays as it is.

    Ids seen before are dropped by the stream's own state, and the next number
    is read from the last trigger's record, so no trigger reads history. A
    repeated trigger replaces its own result.
    """

    def plan(df: DataFrame, batch: int) -> None:
        before = [int(f.getPath().getName()[2:]) for f in _listed(spark, f"{path}/next/b=*")]
        last = max((b for b in before if b < batch), default=None)
        base = spark.read.parquet(f"{path}/next/b={last}").first()["next"] if last is not None else 0
        planned = append_aggregates(df, spark.createDataFrame([(base - 1,)], "idx long"), cap)
        planned.write.mode("overwrite").parquet(f"{path}/rows/b={batch}")
        top = spark.read.parquet(f"{path}/rows/b={batch}").agg(F.max("idx")).first()[0]
        spark.createDataFrame([(base if top is None else top + 1,)], "next long").coalesce(1).write.mode("overwrite").parquet(f"{path}/next/b={batch}")

    drain(stream.dropDuplicates(["sub_piece_cid"]), each=plan)


def _listed(spark: SparkSession, pattern: str) -> list:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return list(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or [])


def planned(spark: SparkSession, path: str) -> DataFrame:
    """(sub_piece_cid, idx, oversized) of everything planned so far."""
    return spark.read.schema("sub_piece_cid long, idx long, oversized boolean").option("recursiveFileLookup", "true").parquet(f"{path}/rows")


_CAP = 2 << 20


@query("st5_incremental_planner", f"""RECURSIVE fp AS (SELECT sub_piece_cid, sub_piece_cid % 3 AS slice, {PADDED_SQL} AS padded FROM sub_pieces WHERE status = 'built'), o AS (SELECT *, row_number() OVER (ORDER BY slice, sub_piece_cid) AS i FROM fp WHERE padded <= {_CAP}),
    f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, -1::BIGINT AS bin, NULL::BIGINT AS sub_piece_cid, -1::BIGINT AS slice UNION ALL SELECT o.i, CASE WHEN used + padded > {_CAP} OR o.slice <> f.slice THEN padded ELSE used + padded END, CASE WHEN used + padded > {_CAP} OR o.slice <> f.slice THEN bin + 1 ELSE bin END, o.sub_piece_cid, o.slice FROM f JOIN o ON o.i = f.i + 1)
    SELECT sub_piece_cid, bin AS idx, false AS oversized FROM f WHERE i > 0 UNION ALL SELECT sub_piece_cid, NULL, true FROM fp WHERE padded > {_CAP}""")
def st5(spark, d):
    """Three slices of sub-pieces, the second of which brings the first one's again."""
    path = f"{shared_dir(spark)}/plan-{uuid.uuid4().hex}"
    sub = fx.sub_pieces(spark, d).where("status = 'built'").select("sub_piece_cid", "raw_size", (F.col("sub_piece_cid") % 3).alias("slice"))
    again = sub.where("slice = 0").withColumn("slice", F.lit(1).cast("long"))
    incremental_plan(spark, as_stream(sub.union(again), "sub_piece_cid", slice_of=F.col("slice")).select("sub_piece_cid", "raw_size"), path, _CAP)
    return planned(spark, path)


@query("st6_intake_dedupe", "SELECT DISTINCT trim(line) AS id FROM lines WHERE trim(line) LIKE 'f0155%'")
def st6(spark, d):
    """One id for each canonical form in a stream of lines, in the spelling that came first, with exact state."""
    s = as_stream(fx.lines(spark, d), "line_no")
    return drain(canonical_stream(content_lines(s).select("id")).where("valid").dropDuplicates(["canonical"]).select("id")).select("id")
