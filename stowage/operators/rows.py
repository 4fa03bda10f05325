"""Row classifiers and scalar functions over fixtures, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import columns as c
from ..registry import query

_ATT = "SELECT event_id, "


def _att(name: str, column, sql: str) -> None:
    """A classifier of attempts, one row per event."""
    query(name, f"SELECT event_id, {sql} AS value FROM attempts")(lambda spark, d: fx.attempts(spark, d).select("event_id", column().alias("value")))


_MSG = lambda: F.array_compact(F.array("message"))
_att("row1_classify_failure", lambda: c.classify_failure(F.coalesce("message", F.lit(""))), """CASE WHEN contains(lower(coalesce(message,'')), '429') OR contains(lower(coalesce(message,'')), 'too many requests') THEN 'source_gateway_429'
    WHEN regexp_matches(coalesce(message,''), '\\b5\\d\\d\\b') THEN 'source_gateway_5xx' WHEN contains(coalesce(message,''), 'timeout') THEN 'source_gateway_timeout' ELSE 'other' END""")
_att("row2_classify_status", lambda: c.classify_status(F.col("status")), "CASE WHEN status = 429 THEN 'source_gateway_429' WHEN status >= 500 AND status < 600 THEN 'source_gateway_5xx' ELSE 'other' END")
_att(
    "row3_classify_transport",
    lambda: c.classify_transport(F.array(F.struct(F.when(F.col("event_id") % 4 == 0, "AbortError").alias("name"), F.when(F.col("event_id") % 4 == 1, "ECONNRESET").when(F.col("event_id") % 4 == 2, "ETIMEDOUT").alias("code")), F.struct(F.lit(None).cast("string").alias("name"), F.when(F.col("event_id") % 3 == 0, "UND_ERR_BODY_TIMEOUT").alias("code")))),
    "CASE event_id % 4 WHEN 0 THEN 'source_gateway_timeout' WHEN 1 THEN 'source_gateway_network' WHEN 2 THEN 'source_gateway_timeout' ELSE CASE WHEN event_id % 3 = 0 THEN 'source_gateway_timeout' ELSE 'source_gateway_network' END END",
)
_att("row4_classify_block_error", lambda: c.classify_block_error(_MSG()), "CASE WHEN message LIKE 'received 429 %' THEN 'source_gateway_429' WHEN regexp_matches(message, 'received 5\\d\\d ') THEN 'source_gateway_5xx' WHEN message ILIKE '%aborted%' THEN 'source_gateway_timeout' WHEN message ILIKE '%fetch failed%' THEN 'source_gateway_network' WHEN message LIKE '%did not match multihash%' THEN 'car_root_mismatch' ELSE 'other' END")
_att("row5_is_transient", lambda: c.is_transient(_MSG()), "coalesce(regexp_matches(message, '(?i)received (429|5\\d\\d) |fetch failed'), false)")
_att(
    "row6_describe_failure",
    lambda: F.concat_ws("|", c.failure_headline(F.array_compact(F.array("message", "message", "source"))), c.failure_detail(F.array_compact(F.array("message", "message", "source")))),
    """CASE WHEN message LIKE '%did not match multihash%' THEN 'gateway returned bytes that do not match the CID — switch gateway' WHEN regexp_matches(message, 'received (429|5\\d\\d) ') THEN 'gateway kept timing out on a block — likely not cached there; retry, or switch gateway'
    WHEN regexp_matches(message, '(?i)failed to fetch') THEN 'network failure while fetching — check connectivity and retry' ELSE coalesce(message, source) END || '|' || CASE WHEN message IS NULL THEN source ELSE message || ' ← ' || source END""",
)
_att("row7_should_fallback", lambda: c.should_fallback(c.classify_block_error(_MSG())), "message IS NOT NULL")


def below_floor(df: DataFrame, minimum: int, size: str = "raw_size") -> DataFrame:
    """Rows whose padded size is under a provider's minimum, compared padded with padded."""
    return df.where(c.padded_size(F.col(size)) < minimum)


_PAD = "CAST(pow(2, ceil(log2(greatest(128, ceil(raw_size * 128 / 127.0))))) AS BIGINT)"


@query("row8_below_floor", f"SELECT sub_piece_cid, {_PAD} AS padded, raw_size <= 520192 AS small FROM sub_pieces WHERE {_PAD} < 2097152 AND raw_size > 0")
def row8(spark, d):
    return below_floor(fx.sub_pieces(spark, d).where("raw_size > 0"), 1 << 21).select("sub_piece_cid", c.padded_size(F.col("raw_size")).alias("padded"), (F.col("raw_size") <= 520192).alias("small"))


def split_oversize(df: DataFrame, cap: int, size: str = "raw_size") -> tuple[DataFrame, DataFrame]:
    """(fitting, oversized)."""
    return df.where(F.col(size) <= cap), df.where(F.col(size) > cap)


@query("row9_split_oversize", "SELECT object_id, raw_size > 8000 AS oversized FROM objects")
def row9(spark, d):
    fit, over = split_oversize(fx.objects(spark, d).select("object_id", "raw_size"), 8000)
    return fit.select("object_id", F.lit(False).alias("oversized")).union(over.select("object_id", F.lit(True)))


def split_unservable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(servable, unservable) done rows, by whether they have a URL."""
    done = df.where("status = 'done'")
    return done.where(F.coalesce("url", F.lit("")) != ""), done.where(F.coalesce("url", F.lit("")) == "")


@query("row10_split_unservable", "SELECT cid, url IS NOT NULL AS servable FROM pieces WHERE status = 'done'")
def row10(spark, d):
    yes, no = split_unservable(fx.pieces(spark, d))
    return yes.select("cid", F.lit(True).alias("servable")).union(no.select("cid", F.lit(False)))


def resumable(aggs: DataFrame) -> DataFrame:
    return aggs.where(F.col("status").isin("planned", "submitted", "parked", "add_unconfirmed"))


def awaiting_receipt(aggs: DataFrame) -> DataFrame:
    return aggs.where(F.col("tx_hash").isNotNull() & (F.col("status") != "committed"))


@query("row11_resumable", "SELECT idx, status, tx_hash IS NOT NULL AS awaiting FROM aggregates WHERE status IN ('planned','submitted','parked','add_unconfirmed')")
def row11(spark, d):
    a = resumable(fx.aggregates(spark, d))
    return a.join(awaiting_receipt(a).select("idx", F.lit(True).alias("w")), "idx", "left").select("idx", "status", F.coalesce("w", F.lit(False)).alias("awaiting"))


def grant_status(grants: DataFrame, now: int, permissions: tuple[str, ...] = ("create", "add")) -> DataFrame:
    """grants (grant, permission, expires): expiry is the least over the permissions, 0 for one that is missing."""
    have = grants.groupBy("grant").agg(*[F.max(F.when(F.col("permission") == p, F.col("expires"))).alias(p) for p in permissions])
    least = F.least(*[F.coalesce(p, F.lit(0)) for p in permissions])
    return have.select("grant", least.alias("expires"), (least > now).alias("usable"), (least > now + c.GRANT_MARGIN_S).alias("can_presign"))


@query("row12_grant_status", """g AS (SELECT user_id AS "grant", max(CASE WHEN event_type = 'click' THEN CAST(floor(epoch(ts)) AS BIGINT) END) AS a, max(CASE WHEN event_type = 'view' THEN CAST(floor(epoch(ts)) AS BIGINT) END) AS b FROM events WHERE event_type IN ('click','view') GROUP BY user_id)
    SELECT "grant", least(coalesce(a,0), coalesce(b,0)) AS expires, least(coalesce(a,0), coalesce(b,0)) > 1705000000 AS usable, least(coalesce(a,0), coalesce(b,0)) > 1705003600 AS can_presign FROM g""")
def row12(spark, d):
    e = fx.read(spark, d, "events").where("event_type in ('click', 'view')")
    return grant_status(e.select(F.col("user_id").alias("grant"), F.when(F.col("event_type") == "click", "create").otherwise("add").alias("permission"), F.unix_timestamp("ts").alias("expires")), 1705000000)


_S13 = "CASE event_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'confirmed' END"


@query("row13_interpret_add_status", f"""s AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS http, {_S13} AS tx, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS m, event_id % 5 <> 0 AS p FROM events)
    SELECT event_id, http <> 404 AND (tx = 'failed' OR (tx = 'confirmed' AND (coalesce(m = false, false) OR (coalesce(m, false) AND p)))) AS done, http <> 404 AND tx = 'confirmed' AND coalesce(m, false) AND p AS ok,
    CASE WHEN http = 404 THEN NULL WHEN tx = 'failed' THEN 'tx failed on chain' WHEN tx = 'confirmed' AND m = false THEN 'AddPieces tx confirmed but reverted (receipt status 0)' END AS reason FROM s""")
def row13(spark, d):
    k = F.col("event_id")
    tx = F.when(k % 4 == 0, "failed").when(k % 4 == 1, "pending").otherwise("confirmed")
    out = c.interpret_add_status(F.when(k % 11 == 0, 404).otherwise(200), tx, F.when(k % 3 == 0, True).when(k % 3 == 1, False), k % 5 != 0)
    return fx.read(spark, d, "events").select(k, out.alias("r")).select("event_id", "r.*")


@query("row14_fee_level", "SELECT event_id, CASE WHEN fee >= 200000 THEN 'spike' WHEN fee * 10 >= 200000 THEN 'rising' ELSE 'ok' END AS level, CAST(fee // 100 AS BIGINT) AS multiple, fee >= 200000 AS pause FROM fees")
def row14(spark, d):
    f = F.col("fee")
    return fx.fees(spark, d).select("event_id", c.fee_level(f).alias("level"), c.fee_multiple(f).alias("multiple"), (c.fee_level(f) == "spike").alias("pause"))


def proof_health(df: DataFrame) -> DataFrame:
    """df (last_proven, next_challenge, current, max_add) with last_proven 0 as null, proven_since_add, in_good_standing."""
    proven = F.nullif(F.col("last_proven"), F.lit(0))
    return df.withColumn("proven_since_add", F.coalesce(proven.isNotNull() & (F.col("max_add").isNull() | (proven >= F.col("max_add"))), F.lit(False))).withColumn("in_good_standing", F.coalesce("next_challenge", "current") >= F.col("current")).withColumn("last_proven", proven)


@query("row15_proof_health", """s AS (SELECT tx, CASE WHEN block % 4 = 0 THEN 0 ELSE block END AS lp, CASE WHEN block % 3 <> 0 THEN block + block % 7 - 3 END AS nc, block AS cur, CASE WHEN block % 5 <> 0 THEN block - 2 + block % 6 END AS ma FROM receipts)
    SELECT tx, nullif(lp, 0) AS last_proven, lp <> 0 AND (ma IS NULL OR lp >= ma) AS proven_since_add, coalesce(nc, cur) >= cur AS in_good_standing FROM s""")
def row15(spark, d):
    b = F.col("block")
    r = fx.receipts(spark, d).select("tx", F.when(b % 4 == 0, 0).otherwise(b).alias("last_proven"), F.when(b % 3 != 0, b + b % 7 - 3).alias("next_challenge"), b.alias("current"), F.when(b % 5 != 0, b - 2 + b % 6).alias("max_add"))
    return proof_health(r).select("tx", "last_proven", "proven_since_add", "in_good_standing")


_J = "j AS (SELECT source, count(*) * 1000 AS n, sum(raw_size) * 100000 AS b, min(object_id) AS k FROM objects GROUP BY source), w AS (SELECT *, CASE k % 3 WHEN 0 THEN 20.0 WHEN 1 THEN 200.0 END AS mbit, CASE WHEN k % 4 <> 0 THEN k % 4 * 100 * 1073741824 END AS free, (k % 5) / 50.0 AS rate FROM j)"
_PROFILE = "CASE WHEN n <= 1000 AND b < 5368709120 THEN 'Laptop tester' WHEN coalesce(mbit < 50, false) THEN 'Bandwidth-bound migrator' WHEN n >= 100000 AND coalesce(free, 0) >= 137438953472 THEN 'Production migrator' ELSE 'SMB / small studio' END"


def _jobs(spark, d):
    o = fx.objects(spark, d).groupBy("source").agg((F.count("*") * 1000).alias("n"), (F.sum("raw_size") * 100000).alias("b"), F.min("object_id").alias("k"))
    k = F.col("k")
    return o.withColumn("mbit", F.when(k % 3 == 0, 20.0).when(k % 3 == 1, 200.0)).withColumn("free", F.when(k % 4 != 0, k % 4 * 100 * c.GIB)).withColumn("rate", (k % 5) / 50.0)


@query("row16_match_profile", f"{_J} SELECT source, {_PROFILE} AS profile FROM w")
def row16(spark, d):
    return _jobs(spark, d).select("source", c.profile_name(F.col("n"), F.col("b"), F.col("free"), F.col("mbit")).alias("profile"))


@query("row17_cache_rule", f"{_J}, p AS (SELECT *, CASE WHEN {_PROFILE} = 'Production migrator' THEN 4 ELSE 1 END AS f FROM w) SELECT source, CASE WHEN rate > 0.05 THEN 'required' WHEN free IS NULL OR free >= f * 34359738368 + 10737418240 THEN 'recommended' ELSE 'stream-only' END AS mode, CASE WHEN rate > 0.05 OR free IS NULL OR free < f * 34359738368 + 10737418240 THEN 1 ELSE 0 END AS n_warnings FROM p")
def row17(spark, d):
    j = _jobs(spark, d).withColumn("f", c.in_flight_of(c.profile_name(F.col("n"), F.col("b"), F.col("free"), F.col("mbit"))))
    return j.select("source", c.cache_mode(F.col("f"), F.col("free"), F.col("rate")).alias("mode"), F.size(c.cache_warnings(F.col("f"), F.col("free"), F.col("rate"))).alias("n_warnings"))


_KNOBS = "{'max_in_flight': CASE WHEN name = 'Production migrator' THEN 4 ELSE 1 END, 'piece_size': '32GiB', 'pull_batch': 32, 'ingress': CASE WHEN name = 'Laptop tester' THEN 'cloudflared' ELSE 'funnel' END, 'car_store': 'recommended'}"


@query("row16_profile_reasons", f"""{_J}, x AS (SELECT *, {_PROFILE} AS name FROM w), y AS (SELECT *, {_KNOBS} AS knobs FROM x) SELECT source, name, CASE name WHEN 'Laptop tester' THEN ['at most 1000 ids', 'estimated ' || printf('%.1f', b / 1073741824) || ' GiB'] WHEN 'Bandwidth-bound migrator' THEN ['upload of ' || printf('%.0f', mbit) || ' Mbit/s is below 50']
    WHEN 'Production migrator' THEN [n || ' ids are at least 100000', 'free space of ' || printf('%.0f', free / 1073741824) || ' GiB is at least 128'] ELSE ['no other profile fits'] END AS reasons, knobs.max_in_flight AS max_in_flight, knobs.ingress AS ingress, knobs.car_store AS car_store FROM y""")
def row16_reasons(spark, d):
    found = _jobs(spark, d).select("source", c.match_profile(F.col("n"), F.col("b"), F.col("free"), F.col("mbit")).alias("p"))
    return found.select("source", "p.name", "p.reasons", "p.knobs.max_in_flight", "p.knobs.ingress", "p.knobs.car_store")


@query("row17_cache_warnings", f"""{_J}, p AS (SELECT *, CASE WHEN {_PROFILE} = 'Production migrator' THEN 4 ELSE 1 END AS f FROM w), q AS (SELECT *, (f * 32 + 10)::BIGINT AS need FROM p) SELECT source, CASE WHEN rate > 0.05 THEN ['failure rate of ' || printf('%.0f', floor(rate * 100 + 0.5)) || '% is above 5%: the cached path is required'] WHEN free IS NULL THEN ['free space is unknown']
    WHEN free < need * 1073741824 THEN ['free space of ' || printf('%.0f', free / 1073741824) || ' GiB is below the ' || need || ' GiB for ' || f || ' in flight'] ELSE [] END AS warnings FROM q""")
def row17_warnings(spark, d):
    j = _jobs(spark, d).withColumn("f", c.in_flight_of(c.profile_name(F.col("n"), F.col("b"), F.col("free"), F.col("mbit"))))
    return j.select("source", c.cache_warnings(F.col("f"), F.col("free"), F.col("rate")).alias("warnings"))


def funding_ready(df: DataFrame) -> DataFrame:
    return df.withColumn("ready", F.col("approved") & (F.col("available") > 0))


@query("row19_funding_ready", "SELECT c_custkey, c_custkey % 2 = 0 AND c_acctbal > 0 AS ready FROM customer")
def row19(spark, d):
    t = fx.read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("approved"), F.col("c_acctbal").alias("available"))
    return funding_ready(t).select("c_custkey", "ready")


def derive_phase(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("ctx").agg(F.when(F.bool_and("committed"), "done").when(F.bool_or(F.col("tx").isNotNull() & ~F.col("committed")), "confirming").otherwise("queued").alias("phase"))


@query("row20_derive_phase", "SELECT ctx, CASE WHEN bool_and(committed) THEN 'done' WHEN bool_or(tx IS NOT NULL AND NOT committed) THEN 'confirming' ELSE 'queued' END AS phase FROM chunks GROUP BY ctx")
def row20(spark, d):
    return derive_phase(fx.chunks(spark, d))


@query("fn1_canonical_url", "SELECT cid, 'https://' || gateway || '/ipfs/' || cid || '?format=car&dag-scope=all&car-version=1&car-order=dfs&car-dups=n' AS url FROM pieces")
def fn1(spark, d):
    return fx.pieces(spark, d).select("cid", c.canonical_url(F.concat(F.lit("https://"), "gateway", F.lit("//")), F.col("cid")).alias("url"))


@query("fn2_raw_block_url", "SELECT node, 'https://g/ipfs/' || node || '?format=raw' AS url FROM blocks")
def fn2(spark, d):
    return fx.blocks(spark, d).select("node", c.raw_block_url(F.lit("https://g/"), F.col("node")).alias("url"))


@query("fn3_relay_url", "SELECT cid, 'https://relay/r/' || gateway || '/' || cid || '/piece/' || piece_cid AS url FROM pieces")
def fn3(spark, d):
    return fx.pieces(spark, d).select("cid", c.relay_url(F.lit("https://relay/"), F.col("gateway"), F.col("cid"), F.col("piece_cid")).alias("url"))


@query("fn4_pull_source_url", "SELECT sub_piece_cid, CASE WHEN url IS NOT NULL THEN 'https://relay/r/s.example/' || sub_piece_cid || '/piece/' || sub_piece_cid END AS relayed, 'https://base/piece/' || sub_piece_cid AS direct FROM sub_pieces")
def fn4(spark, d):
    k = F.col("sub_piece_cid").cast("string")
    return fx.sub_pieces(spark, d).select("sub_piece_cid", c.pull_source_url(F.lit("x"), F.lit("https://relay"), F.col("url"), k, k).alias("relayed"), c.pull_source_url(F.lit("https://base/"), F.lit(None).cast("string"), F.col("url"), k, k).alias("direct"))


@query("fn4_pull_source_error", "SELECT sub_piece_cid, CASE WHEN url IS NULL THEN 'sub-piece ' || sub_piece_cid || ' has no gateway URL' WHEN sub_piece_cid % 6 = 0 THEN 'sub-piece ' || sub_piece_cid || ' has an invalid URL' END AS relayed, CAST(NULL AS VARCHAR) AS direct FROM sub_pieces")
def fn4_error(spark, d):
    k, url = F.col("sub_piece_cid"), F.col("url")
    broken = F.when(k % 6 == 0, F.regexp_replace(url, "^https:/", "")).otherwise(url)
    return fx.sub_pieces(spark, d).select("sub_piece_cid", c.pull_source_error(F.lit("https://relay"), broken, k.cast("string")).alias("relayed"), c.pull_source_error(F.lit(""), broken, k.cast("string")).alias("direct"))


@query("fn5_parse_size", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS BIGINT) * 1073741824 WHEN 1 THEN CAST(p_size AS BIGINT) * 1048576 WHEN 2 THEN p_size END AS bytes FROM part")
def fn5(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit(" "), n, F.lit("GiB"))).when(k % 4 == 1, F.concat(n, F.lit(" m"))).when(k % 4 == 2, n).otherwise(F.concat(n, F.lit("parsecs")))
    return fx.read(spark, d, "part").select("p_partkey", c.parse_size(text).alias("bytes"))


@query("fn5_size_error", """SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'unknown size unit "parsecs" in ' || p_size || ' Parsecs' WHEN 2 THEN 'invalid size: -' || p_size WHEN 3 THEN 'size out of range: ' || p_size || '00000000TiB' END AS error, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS BIGINT) * 1099511627776 WHEN 4 THEN p_size END AS bytes FROM part""")
def fn5_error(spark, d):
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(n, F.lit("TiB"))).when(k == 1, F.concat(n, F.lit(" Parsecs"))).when(k == 2, F.concat(F.lit("-"), n)).when(k == 3, F.concat(n, F.lit("00000000TiB"))).otherwise(n)
    return fx.read(spark, d, "part").select("p_partkey", c.size_error(text).alias("error"), c.parse_size(text).alias("bytes"))


@query("fn6_format", """SELECT object_id, CASE WHEN raw_size >= 1048576 THEN (raw_size * 200 + 1048576) // 209715200 || '.' || lpad(CAST((raw_size * 200 + 1048576) // 2097152 % 100 AS VARCHAR), 2, '0') || ' MiB'
    WHEN raw_size >= 1024 THEN (raw_size * 200 + 1024) // 204800 || '.' || lpad(CAST((raw_size * 200 + 1024) // 2048 % 100 AS VARCHAR), 2, '0') || ' KiB' ELSE raw_size || ' B' END AS size,
    CASE WHEN raw_size < 1000 THEN raw_size || 'ms' WHEN raw_size % 1000 = 250 THEN raw_size // 1000 || '.3s' ELSE format('{:.1f}s', raw_size / 1000) END AS duration FROM objects""")
def fn6(spark, d):
    n = F.col("raw_size")
    return fx.objects(spark, d).select("object_id", c.format_bytes(n).alias("size"), c.format_duration(n).alias("duration"))


@query("fn7_padded_size", f"SELECT object_id, {_PAD} AS padded, CAST(log2({_PAD} / 32) AS INTEGER) AS height, {_PAD} // 128 * 127 - raw_size AS padding FROM objects")
def fn7(spark, d):
    n = F.col("raw_size")
    return fx.objects(spark, d).select("object_id", c.padded_size(n).alias("padded"), c.tree_height(n).alias("height"), c.padding(n).alias("padding"))


@query("fn8_format_token", "SELECT event_id, (fee // 100000) || '.' || lpad(CAST(fee % 100000 // 10 AS VARCHAR), 4, '0') AS token FROM fees")
def fn8(spark, d):
    return fx.fees(spark, d).select("event_id", c.format_token((F.col("fee") * F.lit(10000000000000).cast("decimal(15,0)")).cast("decimal(38,0)")).alias("token"))


@query("fn10_explorer_url", "SELECT idx, 'https://explorer.example/dataset/7' || CASE WHEN idx % 2 = 0 THEN '/piece/' || idx ELSE '' END AS url FROM aggregates")
def fn10(spark, d):
    return fx.aggregates(spark, d).select("idx", c.explorer_url(F.lit(7), F.when(F.col("idx") % 2 == 0, F.col("idx"))).alias("url"))
