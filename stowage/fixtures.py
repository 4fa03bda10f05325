"""Inventory, lifecycle and ledger tables derived from the supplied tables by Spark, so that they grow with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
STATUSES = ("planned", "submitted", "parked", "add_unconfirmed", "committed", "failed")


def base32_sql(digits: str, n: int) -> str:
    """SQL for the base32 id of n letters after its prefix that spells the bytes of an expression for lower-case hex digits."""
    bits = f"rpad(array_to_string(list_transform(string_split({digits}, ''), lambda h: right('000' || bin(('0x' || h)::BIGINT), 4)), ''), {n * 5}, '0')"
    letter = "list_sum(list_transform(range(5), lambda j: CASE WHEN b[i * 5 + j + 1] = '1' THEN 16 >> j ELSE 0 END))::BIGINT + 1"
    return f"('b' || (SELECT array_to_string(list_transform(range({n}), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', {letter}, 1)), '') FROM (SELECT {bits} AS b)))"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def objects(spark, d) -> DataFrame:
    """object_id, payload, digest_hex, raw_size, source, lang: one object per document."""
    t = read(spark, d, "documents")
    return t.select(F.col("doc_id").alias("object_id"), F.col("text").cast("binary").alias("payload"), F.sha2(F.col("text").cast("binary"), 256).alias("digest_hex"), F.octet_length("text").cast("long").alias("raw_size"), "source", "lang")


def pieces(spark, d) -> DataFrame:
    """cid, piece_cid, raw_size, gateway, url, status, failure_category: one row per digest."""
    o = objects(spark, d).groupBy("digest_hex").agg(F.min("object_id").alias("k"), F.first("raw_size").alias("raw_size"), F.min_by("source", "object_id").alias("gateway"))
    k = F.col("k")
    status = F.when(k % 10 == 0, "failed").when(k % 10 == 1, "pending").when(k % 10 == 2, "processing").when(k % 10 == 3, "oversized").otherwise("done")
    cid = F.concat(F.lit("f01551220"), "digest_hex")
    return o.select(
        cid.alias("cid"), F.concat(F.lit("p"), "digest_hex").alias("piece_cid"), "raw_size", "gateway",
        F.when(k % 17 != 0, F.concat(F.lit("https://"), "gateway", F.lit(".example/ipfs/"), cid, F.lit("?format=car"))).alias("url"),
        status.alias("status"),
        F.when((k % 10 == 0) & (k % 3 == 1), "source_gateway_timeout").when((k % 10 == 0) & (k % 3 == 2), "car_root_mismatch").alias("failure_category"), k.alias("k"),
    )


def lines(spark, d) -> DataFrame:
    """line_no, line: an inventory text with comments, blanks and junk."""
    o = objects(spark, d)
    k = F.col("object_id")
    return o.select((k + 1).alias("line_no"), F.when(k % 13 == 0, "# c").when(k % 11 == 0, "   ").when(k % 7 == 0, F.concat(F.lit("not-an-id-"), k.cast("string"))).otherwise(F.concat(F.lit("  f01551220"), "digest_hex")).alias("line"))


def attempts(spark, d) -> DataFrame:
    """id, source, rank, ok, status, message, bytes, digest, started, latency_ms, event_id: fetch attempts."""
    e = read(spark, d, "events")
    k = F.col("event_id")
    bad = F.col("event_type") == "error"
    message = F.when(k % 5 == 0, "received 429 Too Many").when(k % 5 == 1, "received 503 Unavailable").when(k % 5 == 2, "The operation was aborted").when(k % 5 == 3, "fetch failed").otherwise("bytes did not match multihash")
    return e.select(
        F.col("user_id").alias("id"), F.concat(F.lit("g"), (k % 4).cast("string")).alias("source"), (k % 4).alias("rank"), (~bad).alias("ok"),
        F.when(bad, F.when(k % 5 == 0, 429).when(k % 5 == 1, 503).otherwise(0)).otherwise(200).alias("status"), F.when(bad, message).alias("message"),
        F.floor(F.col("value") * 100).alias("bytes"), F.md5("props").alias("digest"), F.col("ts").alias("started"), F.floor("value").alias("latency_ms"), k.alias("event_id"),
    )


def lifecycle(spark, d) -> DataFrame:
    """key, seq, ts, kind: lifecycle events of keys in order."""
    kinds = {"signup": "planned", "view": "submitted", "click": "parked", "purchase": "committed", "error": "failed"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    return read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts", F.coalesce(kind, F.lit("planned")).alias("kind"))


def aggregates(spark, d) -> DataFrame:
    """idx, status, tx_hash, error: one aggregate per order."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "O", "planned").when(k % 3 == 0, "submitted").when(k % 3 == 1, "parked").otherwise("add_unconfirmed")
    return read(spark, d, "orders").select(k.alias("idx"), status.alias("status"), F.when(k % 7 != 0, F.concat(F.lit("0x"), k.cast("string"))).alias("tx_hash"), F.when(k % 11 == 0, "breadcrumb").alias("error"))


def aggregate_members(spark, d) -> DataFrame:
    """aggregate_idx, segment_index, sub_piece_cid: ordered sub-pieces of each aggregate."""
    w = Window.partitionBy("l_orderkey").orderBy(*SEGMENT_ORDER)
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("aggregate_idx"), (F.row_number().over(w) - 1).cast("long").alias("segment_index"), F.col("l_partkey").alias("sub_piece_cid"))


def sub_pieces(spark, d) -> DataFrame:
    """sub_piece_cid, raw_size, status, url, car_path: one sub-piece per part; either a URL or a container path."""
    k = F.col("p_partkey")
    return read(spark, d, "part").select(
        k.alias("sub_piece_cid"), F.round(F.col("p_retailprice") * 1000).cast("long").alias("raw_size"), F.when(k % 19 == 0, "planned").otherwise("built").alias("status"),
        F.when(k % 2 == 0, F.concat(F.lit("https://s.example/"), k.cast("string"))).alias("url"), F.when(k % 2 == 1, F.concat(F.lit("/cars/"), k.cast("string"), F.lit(".car"))).alias("car_path"),
    )


def sub_piece_members(spark, d) -> DataFrame:
    """sub_piece_cid, member_cid, member_sort_order: source ids of each sub-piece."""
    m = read(spark, d, "lineitem").select(F.col("l_partkey").alias("sub_piece_cid"), F.col("l_suppkey").alias("member_cid")).repartition("sub_piece_cid").distinct()  # one shuffle for rows and places
    return m.select("sub_piece_cid", "member_cid", (F.row_number().over(Window.partitionBy("sub_piece_cid").orderBy("member_cid")) - 1).cast("long").alias("member_sort_order"))


def ledger(spark, d) -> DataFrame:
    """root: what the ledger lists; some roots are foreign."""
    own = read(spark, d, "orders").where("o_orderkey % 5 < 3").select(F.col("o_orderkey").alias("root"))
    foreign = read(spark, d, "customer").where("c_custkey % 100 = 0").select((F.col("c_custkey") + 1_000_000_000).alias("root"))
    return own.union(foreign)


def receipts(spark, d) -> DataFrame:
    """tx, block."""
    return read(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.concat(F.lit("0x"), F.col("o_orderkey").cast("string")).alias("tx"), F.floor(F.unix_timestamp("o_orderdate") / 30).alias("block"))


def added_events(spark, d, members: DataFrame | None = None) -> DataFrame:
    """tx, piece_ids, roots: parallel arrays in segment order; roots hold the aggregate itself at place key mod 3 for most. members: aggregate_members(spark, d) where a caller has them already."""
    m = (aggregate_members(spark, d) if members is None else members).groupBy("aggregate_idx").agg(F.array_sort(F.collect_list(F.struct("segment_index", "sub_piece_cid"))).alias("m"))
    k = F.col("aggregate_idx")
    roots = F.transform("m", lambda x: F.when((x["segment_index"] == k % 3) & (k % 4 != 0), k).otherwise(-x["sub_piece_cid"] - 1))
    return m.where("aggregate_idx % 7 <> 0").select(F.concat(F.lit("0x"), k.cast("string")).alias("tx"), F.transform("m", lambda x: x["segment_index"] * 10 + k % 10).alias("piece_ids"), roots.alias("roots"))


def links(spark, d) -> DataFrame:
    """parent, link_index, child: region > nation > customer > order > part, with shared parts."""
    name = lambda kind, column: F.concat(F.lit(kind), F.col(column).cast("string"))
    link = lambda table, parent, child, o: read(spark, d, table).select(parent.alias("parent"), child.alias("child"), F.col(o).cast("long").alias("o"))
    r = link("nation", name("r", "n_regionkey"), name("n", "n_nationkey"), "n_nationkey")
    n = link("customer", name("n", "c_nationkey"), name("c", "c_custkey"), "c_custkey")
    c = link("orders", name("c", "o_custkey"), name("o", "o_orderkey"), "o_orderkey")
    ordered = read(spark, d, "orders").select(name("o", "o_orderkey").alias("parent"))
    lines = read(spark, d, "lineitem").select(name("o", "l_orderkey").alias("parent"), F.col("l_partkey").cast("long").alias("o")).repartition("parent")  # one shuffle for all that follows
    p = lines.join(ordered, "parent", "left_semi").distinct().select("parent", F.concat(F.lit("p"), F.col("o").cast("string")).alias("child"), "o")
    upper = r.union(n).union(c)
    numbered = lambda t: t.select("parent", (F.row_number().over(Window.partitionBy("parent").orderBy("o")) - 1).cast("long").alias("link_index"), "child")
    return numbered(upper).union(numbered(p))


def blocks(spark, d, of: DataFrame | None = None) -> DataFrame:
    """node, bytes, digest: delivered blocks; every 13th part is missing and every 17th altered. of: links(spark, d) where a caller has them already."""
    nodes = (links(spark, d) if of is None else of).select(F.col("child").alias("node")).distinct()
    k = F.when(F.col("node").startswith("p"), F.substring("node", 2, 20).cast("long"))
    own = F.sha2(F.col("node").cast("binary"), 256)
    return nodes.where(F.coalesce(k % 13 != 0, F.lit(True))).select("node", F.when(F.coalesce(k % 17 == 0, F.lit(False)), F.concat("node", F.lit("!"))).otherwise(F.col("node")).cast("binary").alias("bytes"), own.alias("digest"))


def requests(spark, d) -> DataFrame:
    """req_id, path: pull requests, some malformed."""
    k = F.col("page_id")
    host = F.regexp_extract("url", r"^\w+://([^/:?#]*)", 1)
    part = (k * 7 % 2500).cast("string")
    path = (
        F.when(k % 6 == 0, F.concat(F.lit("/piece/"), part)).when(k % 6 == 1, F.concat(F.lit("/piece/"), part, F.lit("/"), host)).when(k % 6 == 2, F.concat(F.lit("/piece/%41"), part))
        .when(k % 6 == 3, F.concat(F.lit("/ipfs/"), part)).when(k % 6 == 4, F.concat(F.lit("/piece/"), F.repeat(F.lit("9"), F.lit(600)))).otherwise(F.concat(F.lit("/piece/"), (k * 3 % 2500).cast("string")))
    )
    return read(spark, d, "pages").select(k.alias("req_id"), path.alias("path"))


def chunks(spark, d) -> DataFrame:
    """ctx, chunk, committed, tx, piece_ids: submission chunks of each context."""
    t = read(spark, d, "conversations")
    return t.select(F.col("conv_id").alias("ctx"), F.col("turn").alias("chunk"), (F.col("role") == "assistant").alias("committed"), F.when(F.col("turn") % 3 != 0, F.concat(F.lit("0x"), F.col("turn").cast("string"))).alias("tx"), F.transform(F.sequence(F.lit(0), (F.length("text") % 4).cast("int")), lambda i: F.concat(F.lit("q"), ((F.length("text") + i * 7) % 50).cast("string"))).alias("piece_ids"))


def fees(spark, d) -> DataFrame:
    """ts, fee: base-fee readings."""
    return read(spark, d, "events").select("event_id", "ts", F.floor(F.col("value") * 4000).cast("decimal(38,0)").alias("fee"))


# The same tables in SQL, for the side-by-side check.
SQL = {
    "objects": "SELECT doc_id AS object_id, sha256(text) AS digest_hex, strlen(text) AS raw_size, source, lang FROM documents",
    "pieces0": "SELECT digest_hex, min(object_id) AS k, any_value(raw_size) AS raw_size, arg_min(source, object_id) AS gateway FROM objects GROUP BY digest_hex",
    "pieces": """SELECT 'f01551220' || digest_hex AS cid, 'p' || digest_hex AS piece_cid, raw_size, gateway,
        CASE WHEN k % 17 <> 0 THEN 'https://' || gateway || '.example/ipfs/f01551220' || digest_hex || '?format=car' END AS url,
        CASE k % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' WHEN 3 THEN 'oversized' ELSE 'done' END AS status,
        CASE WHEN k % 10 = 0 AND k % 3 = 1 THEN 'source_gateway_timeout' WHEN k % 10 = 0 AND k % 3 = 2 THEN 'car_root_mismatch' END AS failure_category, k FROM pieces0""",
    "lines": "SELECT object_id + 1 AS line_no, CASE WHEN object_id % 13 = 0 THEN '# c' WHEN object_id % 11 = 0 THEN '   ' WHEN object_id % 7 = 0 THEN 'not-an-id-' || object_id ELSE '  f01551220' || digest_hex END AS line FROM objects",
    "attempts": """SELECT user_id AS id, 'g' || (event_id % 4) AS source, event_id % 4 AS rank, event_type <> 'error' AS ok,
        CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 5 = 0 THEN 429 WHEN event_id % 5 = 1 THEN 503 ELSE 0 END AS status,
        CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'received 429 Too Many' WHEN 1 THEN 'received 503 Unavailable' WHEN 2 THEN 'The operation was aborted' WHEN 3 THEN 'fetch failed' ELSE 'bytes did not match multihash' END END AS message,
        CAST(floor(value * 100) AS BIGINT) AS bytes, md5(props) AS digest, ts AS started, CAST(floor(value) AS BIGINT) AS latency_ms, event_id FROM events""",
    "lifecycle": "SELECT user_id AS key, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'planned' WHEN 'view' THEN 'submitted' WHEN 'click' THEN 'parked' WHEN 'purchase' THEN 'committed' WHEN 'error' THEN 'failed' ELSE 'planned' END AS kind FROM events",
    "aggregates": """SELECT o_orderkey AS idx, CASE WHEN o_orderstatus = 'F' THEN 'committed' WHEN o_orderstatus = 'O' THEN 'planned' WHEN o_orderkey % 3 = 0 THEN 'submitted' WHEN o_orderkey % 3 = 1 THEN 'parked' ELSE 'add_unconfirmed' END AS status,
        CASE WHEN o_orderkey % 7 <> 0 THEN '0x' || o_orderkey END AS tx_hash, CASE WHEN o_orderkey % 11 = 0 THEN 'breadcrumb' END AS error FROM orders""",
    "aggregate_members": f"SELECT l_orderkey AS aggregate_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(SEGMENT_ORDER)}) - 1 AS segment_index, l_partkey AS sub_piece_cid FROM lineitem",
    "sub_pieces": "SELECT p_partkey AS sub_piece_cid, CAST(round(p_retailprice * 1000) AS BIGINT) AS raw_size, CASE WHEN p_partkey % 19 = 0 THEN 'planned' ELSE 'built' END AS status, CASE WHEN p_partkey % 2 = 0 THEN 'https://s.example/' || p_partkey END AS url, CASE WHEN p_partkey % 2 = 1 THEN '/cars/' || p_partkey || '.car' END AS car_path FROM part",
    "sub_piece_members": "SELECT l_partkey AS sub_piece_cid, l_suppkey AS member_cid, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) - 1 AS member_sort_order FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)",
    "ledger": "SELECT o_orderkey AS root FROM orders WHERE o_orderkey % 5 < 3 UNION ALL SELECT c_custkey + 1000000000 FROM customer WHERE c_custkey % 100 = 0",
    "receipts": "SELECT '0x' || o_orderkey AS tx, CAST(floor(epoch(o_orderdate) / 30) AS BIGINT) AS block FROM orders WHERE o_orderkey % 7 <> 0",
    "added_events": """SELECT '0x' || aggregate_idx AS tx, list(segment_index * 10 + aggregate_idx % 10 ORDER BY segment_index) AS piece_ids,
        list(CASE WHEN segment_index = aggregate_idx % 3 AND aggregate_idx % 4 <> 0 THEN aggregate_idx ELSE -sub_piece_cid - 1 END ORDER BY segment_index) AS roots FROM aggregate_members WHERE aggregate_idx % 7 <> 0 GROUP BY aggregate_idx""",
    "links0": """SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, CAST(n_nationkey AS BIGINT) AS o FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer
        UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_orderkey FROM orders UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""",
    "links": "SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY o) - 1 AS link_index, child FROM links0",
    "blocks": """SELECT node, CASE WHEN node LIKE 'p%' AND CAST(node[2:] AS BIGINT) % 17 = 0 THEN node || '!' ELSE node END AS bytes, sha256(node) AS digest FROM (SELECT DISTINCT child AS node FROM links)
        WHERE NOT (node LIKE 'p%' AND CAST(CASE WHEN node LIKE 'p%' THEN node[2:] ELSE '1' END AS BIGINT) % 13 = 0)""",
    "requests": r"""SELECT page_id AS req_id, CASE page_id % 6 WHEN 0 THEN '/piece/' || (page_id * 7 % 2500) WHEN 1 THEN '/piece/' || (page_id * 7 % 2500) || '/' || regexp_extract(url, '^\w+://([^/:?#]*)', 1) WHEN 2 THEN '/piece/%41' || (page_id * 7 % 2500)
        WHEN 3 THEN '/ipfs/' || (page_id * 7 % 2500) WHEN 4 THEN '/piece/' || repeat('9', 600) ELSE '/piece/' || (page_id * 3 % 2500) END AS path FROM pages""",
    "chunks": "SELECT conv_id AS ctx, turn AS chunk, role = 'assistant' AS committed, CASE WHEN turn % 3 <> 0 THEN '0x' || turn END AS tx, list_transform(range(0, length(text) % 4 + 1), lambda i: 'q' || ((length(text) + i * 7) % 50)) AS piece_ids FROM conversations",
    "fees": "SELECT event_id, ts, CAST(floor(value * 4000) AS HUGEINT) AS fee FROM events",
}
_NEEDS = {"pieces0": ["objects"], "pieces": ["pieces0"], "lines": ["objects"], "added_events": ["aggregate_members"], "links": ["links0"], "blocks": ["links"]}


def with_fixtures(body: str) -> str:
    """SQL that defines the fixtures that body names, then body; body may begin with its own CTEs ("name AS (...), SELECT")."""
    import re

    names: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in names:
            names.append(name)

    for name in SQL:
        if re.search(rf"(?<![\w.']){name}(?![\w'])", body):
            need(name)
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    body = body.replace("RECURSIVE ", "")
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    if not head:
        return body if body.lstrip().upper().startswith("SELECT") else f"WITH {recursive}{body}"
    return f"WITH {recursive}{head}{' ' if body.lstrip().upper().startswith('SELECT') else ', '}{body}"
