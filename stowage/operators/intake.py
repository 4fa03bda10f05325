"""Inventory intake and id canonicalisation."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import fixtures as fx
from ..functions import columns as c
from ..registry import query
from .merkle import decode_commitments
from .windows import content_lines, dedupe_first, reject_samples

_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_SCHEMA = "id string, canonical string, version int, codec int, hash_code int, digest binary, valid boolean"


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = raw[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at
        if shift > 63:
            raise ValueError("varint too long")


def _base58(text: str) -> bytes:
    n = 0
    for ch in text:
        n = n * 58 + _BASE58.index(ch)
    return bytes(len(text) - len(text.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def _base32(raw: bytes) -> str:
    return "b" + base64.b32encode(raw).decode().lower().rstrip("=")


def parse_id(text: str | None) -> tuple:
    """(canonical v1 base32, version, codec, hash code, digest, valid) of an id in any usual spelling."""
    try:
        if text[:2] == "Qm" and len(text) == 46:
            raw, version, codec, at = _base58(text), 0, 0x70, 0
        else:
            body = text[1:]
            raw = {"b": lambda: base64.b32decode(body.upper() + "=" * (-len(body) % 8)), "B": lambda: base64.b32decode(body + "=" * (-len(body) % 8)), "f": lambda: bytes.fromhex(body.lower() if body == body.lower() else "x"), "F": lambda: bytes.fromhex(body.lower() if body == body.upper() else "x"), "z": lambda: _base58(body), "u": lambda: base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))}[text[0]]()
            version, at = _varint(raw, 0)
            codec, at = _varint(raw, at)
            if version != 1:
                raise ValueError("version")
        start = at
        code, at = _varint(raw, at)
        size, at = _varint(raw, at)
        if len(raw) - at != size or not code and version == 0:
            raise ValueError("digest")
        head = b"\x01\x70" if version == 0 else raw[:start]
        return _base32(head + raw[start:]), version, codec, code, raw[at:], True
    except (KeyError, ValueError, IndexError, TypeError):
        return None, None, None, None, None, False


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    for batch in batches:
        got = [parse_id(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], [x.split()[0] for x in _SCHEMA.split(", ")])


def canonical_stream(ids: DataFrame) -> DataFrame:
    """canonical, version, codec, hash_code, digest, valid of each row of ids (id): one pass without a shuffle, as a stream needs it."""
    return ids.select("id").mapInArrow(_canonical, _SCHEMA)


def canonicalize_ids(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """df with canonical, version, codec, hash_code, digest, valid of its ids; strict takes canonical spellings only."""
    known = df.select(F.col(column).alias("id")).distinct().mapInArrow(_canonical, _SCHEMA)
    if strict:
        known = known.withColumn("valid", F.col("valid") & (F.col("id") == F.col("canonical")))
    return df.join(known.withColumnRenamed("id", "_id"), F.col(column).eqNullSafe(F.col("_id"))).drop("_id")


@query("set2_canonicalize_ids", "SELECT line_no, version, valid, digest FROM (SELECT line_no, CASE WHEN trim(line) LIKE 'f0155%' THEN 1 END AS version, trim(line) LIKE 'f0155%' AS valid, CASE WHEN trim(line) LIKE 'f0155%' THEN unhex(trim(line)[10:]) END AS digest FROM lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#'))")
def set2(spark, d):
    return canonicalize_ids(content_lines(fx.lines(spark, d)), "id").select("line_no", "version", "valid", "digest")


def intake(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted ids, first rejects, counts) of lines (line_no, line): one id per canonical form, in its first spelling."""
    ids = canonicalize_ids(content_lines(lines), "id")
    good = dedupe_first(ids.where("valid").select("canonical", "line_no", "id"), "canonical", "line_no")
    counts = ids.agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_rejected"))
    return good, reject_samples(ids.where("NOT valid").select("line_no", "id")), counts


@query("set1_intake", "SELECT trim(line) AS id, min(line_no) AS line_no FROM lines WHERE trim(line) LIKE 'f0155%' GROUP BY 1")
def set1(spark, d):
    return intake(fx.lines(spark, d))[0].select("id", "line_no")


def merge_inventories(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct ids of both (id, line_no), the first list's places before the second's."""
    both = a.select("id", F.struct(F.lit(0).alias("list"), "line_no").alias("at")).unionByName(b.select("id", F.struct(F.lit(1).alias("list"), "line_no").alias("at")))
    return dedupe_first(both, "id", "at").select("id", F.col("at.list").alias("list"), F.col("at.line_no").alias("line_no"))


@query("set3_merge_inventories", f"SELECT id, min(list * 1000000000 + line_no) // 1000000000 AS list, min(list * 1000000000 + line_no) % 1000000000 AS line_no FROM (SELECT trim(line) AS id, line_no, line_no % 2 AS list FROM lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')) GROUP BY id")
def set3(spark, d):
    t = content_lines(fx.lines(spark, d))
    return merge_inventories(t.where("line_no % 2 = 0"), t.where("line_no % 2 = 1"))


MANIFEST_VERSION, MOST_SIZE = 1, (1 << 53) - 1


def _first_of(*rules: tuple[Column, str, Column | str]) -> Column:
    """struct(field, problem) of the first rule that is broken, null where none is."""
    out = F.lit(None).cast("struct<field:string,problem:string>")
    for broken, field, problem in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(field).alias("field"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem"))).otherwise(out)
    return out


@F.pandas_udf(StringType())
def canonical_id(ids: pd.Series) -> pd.Series:
    """The canonical spelling of each id, null where it is none; one pass without a join, so it serves streams too."""
    return ids.map(lambda t: parse_id(t)[0]).astype(object)


def is_canonical(column: Column) -> Column:
    return F.coalesce(canonical_id(column) == column, F.lit(False))


def manifest_problems(header: DataFrame, pieces: DataFrame) -> DataFrame:
    """(place, field, problem): the first rule that the header (version, network, gateway) breaks, with place null, and the first that each of the pieces (place, cid, piece_cid, raw_size, url) breaks.

    Ids are in their canonical spelling, commitments decode, sizes are positive
    and below 2^53, and no cid or commitment comes twice; of repeats the later
    rows are at fault, and name the place of the first.
    """
    none = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    said = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("null")) for x in xs])
    scheme = F.lower(F.regexp_extract("gateway", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    web = scheme.isin("http", "https")
    any_piece = pieces.agg((F.count("*") > 0).alias("some"))
    top = header.join(F.broadcast(any_piece)).select(
        F.lit(None).cast("long").alias("place"),
        _first_of(
            (F.col("version") > MANIFEST_VERSION, "version", said("version ", F.col("version"), f" is newer than {MANIFEST_VERSION}")),
            (~F.col("version").eqNullSafe(MANIFEST_VERSION), "version", said(f"version {MANIFEST_VERSION} is expected, not ", F.col("version"))),
            (none("network"), "network", "missing"),
            (none("gateway"), "gateway", "missing"),
            ((scheme == "") | (web & ~F.col("gateway").rlike(r"(?i)^https?:/*[^/?#\s]+")), "gateway", said("not a URL: ", F.col("gateway"))),
            (~web, "gateway", said("not an http(s) URL: ", F.col("gateway"))),
            (~F.col("some"), "pieces", "none"),
        ).alias("p"),
    )
    first = lambda key, name: pieces.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("place").alias(name))
    decoded = decode_commitments(pieces, "piece_cid").where("root IS NOT NULL").select(F.col("id").alias("piece_cid"), F.lit(True).alias("decodes"))
    rows = pieces.join(first("cid", "first_cid"), "cid", "left").join(first("piece_cid", "first_piece"), "piece_cid", "left").join(decoded, "piece_cid", "left")
    at = lambda name: said("already at pieces[", F.col(name), "]")
    each = rows.withColumn("canonical", is_canonical(F.col("cid"))).select(
        "place",
        _first_of(
            (~F.col("canonical"), "cid", said(F.col("cid"), " is no canonical id")),
            (F.col("decodes").isNull(), "pieceCid", said(F.col("piece_cid"), " is no commitment")),
            (~F.coalesce(F.col("raw_size").between(1, MOST_SIZE), F.lit(False)), "rawSize", said(F.col("raw_size"), " is no positive size")),
            (none("url"), "sourceUrl", "missing"),
            (F.col("first_cid") < F.col("place"), "cid", at("first_cid")),
            (F.col("first_piece") < F.col("place"), "pieceCid", at("first_piece")),
        ).alias("p"),
    )
    return top.unionByName(each).where("p IS NOT NULL").select("place", "p.field", "p.problem")


def require_valid(header: DataFrame, pieces: DataFrame) -> None:
    """Raises for the first problem of a manifest: the header's, or that of the row that comes first."""
    found = manifest_problems(header, pieces).orderBy(F.asc_nulls_first("place")).limit(1).collect()
    if found:
        place, field, problem = found[0]
        raise ValueError(f"manifest {'' if place is None else f'pieces[{place}] '}{field}: {problem}")


def manifest_fixture(spark, d) -> DataFrame:
    """place, cid, piece_cid, raw_size, url: rows that break every rule here and there."""
    p = fx.pieces(spark, d).withColumn("digest", F.substring("cid", 10, 64))
    k = F.col("k")
    cid = canonical_id(F.concat(F.lit("f01551220"), "digest"))
    piece = canonical_id(F.concat(F.lit("f0155912022000a"), F.when(k % 60 == 6, F.lit("ab" * 32)).otherwise(F.col("digest"))))
    return p.select(
        k.alias("place"), F.when(k % 50 == 1, F.col("cid")).when(k % 50 == 2, F.lit("Qm1")).when(k % 70 == 3, canonical_id(F.lit("f01551220" + "cd" * 32))).otherwise(cid).alias("cid"),
        F.when(k % 80 == 4, F.col("piece_cid")).when(k % 80 == 5, F.lit(None)).otherwise(piece).alias("piece_cid"), F.when(k % 90 == 7, 0).when(k % 90 == 8, F.lit(1 << 53)).otherwise(F.col("raw_size")).alias("raw_size"), "url",
    )


_B32 = fx.base32_sql
_MANIFEST = f"""r AS (SELECT k AS place, raw_size, url, cid AS hex_cid, piece_cid AS p, cid[10:] AS digest, CASE WHEN k % 60 = 6 THEN repeat('ab', 32) ELSE cid[10:] END AS pd FROM pieces),
    x AS (SELECT place, url, CASE WHEN place % 50 = 1 THEN hex_cid WHEN place % 50 = 2 THEN 'Qm1' WHEN place % 70 = 3 THEN {_B32("'01551220' || repeat('cd', 32)", 58)} ELSE {_B32("'01551220' || r.digest", 58)} END AS cid,
    CASE WHEN place % 80 = 4 THEN p WHEN place % 80 <> 5 THEN {_B32("'0155912022000a' || r.pd", 63)} END AS piece_cid, CASE WHEN place % 90 = 7 THEN 0 WHEN place % 90 = 8 THEN 9007199254740992 ELSE raw_size END AS raw_size FROM r),
    y AS (SELECT *, min(place) OVER (PARTITION BY cid) AS c1, min(place) OVER (PARTITION BY piece_cid) AS p1 FROM x),
    z AS (SELECT place, CASE WHEN cid NOT LIKE 'b%' THEN 'cid' WHEN piece_cid IS NULL OR piece_cid NOT LIKE 'b%' THEN 'pieceCid' WHEN raw_size NOT BETWEEN 1 AND 9007199254740991 THEN 'rawSize' WHEN url IS NULL THEN 'sourceUrl' WHEN c1 < place THEN 'cid' WHEN p1 < place THEN 'pieceCid' END AS field,
    CASE WHEN cid NOT LIKE 'b%' THEN cid || ' is no canonical id' WHEN piece_cid IS NULL OR piece_cid NOT LIKE 'b%' THEN coalesce(piece_cid, 'null') || ' is no commitment' WHEN raw_size NOT BETWEEN 1 AND 9007199254740991 THEN raw_size || ' is no positive size' WHEN url IS NULL THEN 'missing' WHEN c1 < place THEN 'already at pieces[' || c1 || ']' WHEN p1 < place THEN 'already at pieces[' || p1 || ']' END AS problem FROM y)"""


@query("set4_validate_manifest", f"{_MANIFEST} SELECT place, field, problem FROM z WHERE field IS NOT NULL UNION ALL SELECT NULL, 'gateway', 'not an http(s) URL: ftp://g.example'")
def set4(spark, d):
    header = spark.createDataFrame([(1, "calibration", "ftp://g.example")], "version int, network string, gateway string")
    return manifest_problems(header, manifest_fixture(spark, d))


def pull_problem(relay: Column, url: Column, piece: Column) -> Column:
    """Why a sub-piece can't be pulled through the relay: no URL, none that parses, or one whose id isn't canonical; null where it can, or where there is no relay."""
    own = F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://[^/?#]+(?:/ipfs/)?([^?#]*)", 1)
    plain = c.pull_source_error(relay, url, piece)
    relayed = F.coalesce(relay, F.lit("")) != ""
    return F.coalesce(plain, F.when(relayed & ~is_canonical(F.when(relayed & plain.isNull(), own)), F.concat(F.lit("source id "), own, F.lit(" is not canonical"))))


@query("fn4_pull_problem", f"""p AS (SELECT k, cid, url, CASE WHEN k % 3 = 0 THEN {fx.base32_sql("'01551220' || r.cid[10:]", 58)} ELSE cid END AS spelled FROM pieces AS r) SELECT cid, CASE WHEN url IS NULL THEN 'sub-piece ' || k || ' has no gateway URL' WHEN k % 3 <> 0 THEN 'source id ' || spelled || ' is not canonical' END AS problem FROM p""")
def fn4_problem(spark, d):
    k = F.col("k")
    spelled = F.when(k % 3 == 0, canonical_id(F.col("cid"))).otherwise(F.col("cid"))
    url = F.when(F.col("url").isNotNull(), F.concat(F.lit("https://g.example/ipfs/"), spelled, F.lit("?format=car")))
    return fx.pieces(spark, d).select("cid", pull_problem(F.lit("https://relay"), url, k.cast("string")).alias("problem"))


MOST_PATH, SMALL_HOSTS = 512, 10_000


def route_requests(requests: DataFrame, hosts: DataFrame) -> DataFrame:
    """(req_id, status, reason, host, cid, location) of relay requests (req_id, path), by rules in order.

    The one route is /r/<host>/<cid>/piece/<commitment>, split literally; hosts
    (host) are those allowed, compared without case, and the id must be in its
    canonical spelling. The commitment isn't looked at. requests may be a stream.
    """
    allowed = hosts.select(F.lower(F.trim("host")).alias("host")).where("host <> ''").distinct().withColumn("allowed", F.lit(True))
    if allowed.limit(SMALL_HOSTS + 1).count() <= SMALL_HOSTS:
        allowed = F.broadcast(allowed)
    parts = F.split("path", "/", -1)
    at = lambda i: F.get(parts, F.lit(i))
    shape = (
        F.when(F.col("path").isNull() | (F.length("path") > MOST_PATH), "too long").when((F.size(parts) != 6) | (at(1) != "r") | (at(4) != "piece"), "shape")
        .when((at(2) == "") | (at(3) == "") | (at(5) == ""), "empty segment").when(F.contains("path", F.lit("%")), "percent")
    )
    asked = requests.select("req_id", "path", (F.col("path") == "/healthz").alias("healthy"), shape.alias("shape"), F.lower(at(2)).alias("host"), at(3).alias("cid"))
    j = asked.join(allowed, "host", "left").withColumn("canonical", is_canonical(F.when(F.col("shape").isNull(), F.col("cid"))))
    healthy = F.coalesce("healthy", F.lit(False))
    reason = F.when(healthy, F.lit(None)).when(F.col("shape").isNotNull(), F.col("shape")).when(F.col("allowed").isNull(), "host not allowed").when(~F.col("canonical"), "id not canonical")
    good = ~healthy & reason.isNull()
    status = F.when(reason.isNull(), 200).when(reason == "host not allowed", 403).otherwise(404)
    return j.select("req_id", status.alias("status"), reason.alias("reason"), F.when(good, F.col("host")).alias("host"), F.when(good, F.col("cid")).alias("cid"), F.when(good, c.canonical_url(F.concat(F.lit("https://"), "host"), F.col("cid"))).alias("location"))


def relay_requests(spark, d) -> tuple[DataFrame, DataFrame]:
    """(req_id, path) of relay requests in every shape, and (host) of the hosts allowed."""
    pages = fx.read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^\w+://([^/:?#]*)", 1).alias("host"), F.sha2(F.col("url").cast("binary"), 256).alias("digest"))
    k = F.col("page_id")
    path = lambda host, cid: F.concat(F.lit("/r/"), host, F.lit("/"), cid, F.lit("/piece/"), k.cast("string"))
    hex_id = F.concat(F.lit("f01551220"), "digest")
    spelled = (
        F.when(k % 9 == 0, path(F.upper("host"), canonical_id(hex_id))).when(k % 9 == 1, path(F.concat("host", F.lit(":443")), canonical_id(hex_id))).when(k % 9 == 2, path(F.col("host"), hex_id))
        .when(k % 9 == 3, path(F.col("host"), F.concat(F.lit("%62"), "digest"))).when(k % 9 == 4, F.concat(F.lit("/r/"), "host", F.lit("/piece/1"))).when(k % 9 == 5, path(F.repeat(F.lit("h"), F.lit(600)), hex_id))
        .when(k % 9 == 6, F.lit("/healthz")).when(k % 9 == 7, path(F.lit(""), hex_id)).otherwise(path(F.col("host"), canonical_id(hex_id)))
    )
    return pages.select(k.alias("req_id"), spelled.alias("path")), pages.where("page_id % 4 <> 1").select("host").distinct()


@query("fn11_route_request", rf"""g AS (SELECT page_id AS k, regexp_extract(url, '^\w+://([^/:?#]*)', 1) AS host, sha256(url) AS digest FROM pages), h AS (SELECT DISTINCT lower(host) AS host FROM g WHERE k % 4 <> 1 AND host <> ''),
    e AS (SELECT k, CASE WHEN k % 9 = 1 THEN lower(host) || ':443' ELSE lower(host) END AS host, {_B32("'01551220' || g.digest", 58)} AS cid, CASE k % 9 WHEN 3 THEN CASE WHEN host = '' THEN 'empty segment' ELSE 'percent' END WHEN 4 THEN 'shape' WHEN 5 THEN 'too long' WHEN 6 THEN 'ok' WHEN 7 THEN 'empty segment' ELSE CASE WHEN host = '' AND k % 9 <> 1 THEN 'empty segment' END END AS shape FROM g),
    v AS (SELECT *, CASE WHEN shape = 'ok' THEN NULL WHEN shape IS NOT NULL THEN shape WHEN host NOT IN (SELECT host FROM h) THEN 'host not allowed' WHEN k % 9 = 2 THEN 'id not canonical' END AS reason FROM e), w AS (SELECT *, shape IS NULL AND reason IS NULL AS good FROM v)
    SELECT k AS req_id, CASE WHEN reason IS NULL THEN 200 WHEN reason = 'host not allowed' THEN 403 ELSE 404 END AS status, reason, CASE WHEN good THEN host END AS host, CASE WHEN good THEN cid END AS cid,
    CASE WHEN good THEN 'https://' || host || '/ipfs/' || cid || '?format=car&dag-scope=all&car-version=1&car-order=dfs&car-dups=n' END AS location FROM w""")
def fn11(spark, d):
    return route_requests(*relay_requests(spark, d))


@query("src1_inventory_lines", "SELECT line_no, trim(line) AS id FROM lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')")
def src1(spark, d):
    """The inventory written as text and scanned again: line numbers are those of the file."""
    from ..sources.tables import read_inventory, write_lines

    return read_inventory(spark, write_lines(fx.lines(spark, d)))
