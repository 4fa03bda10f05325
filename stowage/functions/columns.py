"""Column functions: failure classifiers, verdict rules, sizes, URLs and renderings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Failure categories, transport codes, size units and thresholds.
RETRIABLE = ("source_gateway_5xx", "source_gateway_429", "source_gateway_timeout", "source_gateway_network", "car_root_mismatch")
TIMEOUT_NAMES = ("AbortError", "TimeoutError")
TIMEOUT_CODES = ("ETIMEDOUT", "UND_ERR_CONNECT_TIMEOUT", "UND_ERR_HEADERS_TIMEOUT", "UND_ERR_BODY_TIMEOUT")
NETWORK_CODES = ("ECONNREFUSED", "ECONNRESET", "EHOSTUNREACH", "ENETUNREACH", "ENOTFOUND", "EAI_AGAIN", "UND_ERR_SOCKET")
UNITS = {"": 0, "b": 0, "k": 10, "kib": 10, "m": 20, "mib": 20, "g": 30, "gib": 30, "t": 40, "tib": 40}
KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
FEE_FLOOR, MAX_FEE = 100, 200_000
GRANT_MARGIN_S = 3600
PROBE_FAILURES, HEADROOM, SLOW_MS = 0.05, 10 * GIB, 500


def _first(*rules: tuple[Column, str], otherwise) -> Column:
    """The value of the first rule that holds."""
    return reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(*rules[0])).otherwise(otherwise)


def classify_failure(message: Column) -> Column:
    m = F.lower(message)
    has = lambda s: m.contains(s)
    return _first(
        (has("429") | has("too many requests"), "source_gateway_429"),
        (m.rlike(r"\b5\d\d\b") | has("bad gateway") | has("service unavailable"), "source_gateway_5xx"),
        (has("timeout") | has("timed out") | has("etimedout"), "source_gateway_timeout"),
        (has("car root mismatch"), "car_root_mismatch"),
        (has("piece commitment") | has("commp"), "commp_mismatch"),
        (has("oversized") | (has("exceeds") & has("piece-size")), "oversized"),
        (has("pull") & has("cap"), "pull_cap_exceeded"),
        otherwise="other",
    )


def classify_status(status: Column) -> Column:
    return _first((status == 429, "source_gateway_429"), (status.between(500, 599), "source_gateway_5xx"), otherwise="other")


def classify_transport(chain: Column) -> Column:
    """Of an array of (name, code) from the error to its causes: a timeout if its sign comes before any network code."""
    sign = F.transform(chain, lambda e: F.when(e["name"].isin(*TIMEOUT_NAMES) | e["code"].isin(*TIMEOUT_CODES), "t").when(e["code"].isin(*NETWORK_CODES), "n"))
    return F.when(F.get(F.array_compact(sign), F.lit(0)) == "t", "source_gateway_timeout").otherwise("source_gateway_network")


def _some(messages: Column, pattern: str) -> Column:
    return F.coalesce(F.exists(messages, lambda m: F.coalesce(m.rlike(pattern), F.lit(False))), F.lit(False))


def classify_block_error(messages: Column) -> Column:
    codes = F.filter(F.transform(messages, lambda m: F.regexp_extract(m, r"received (\d{3}) ", 1)), lambda c: c != "")
    status = F.get(codes, F.lit(0)).cast("int")
    return _first(
        (F.coalesce(status == 429, F.lit(False)), "source_gateway_429"), (F.coalesce(status.between(500, 599), F.lit(False)), "source_gateway_5xx"),
        (_some(messages, "(?i)aborted"), "source_gateway_timeout"), (_some(messages, "(?i)fetch failed|failed to fetch"), "source_gateway_network"),
        (_some(messages, "did not match multihash"), "car_root_mismatch"), otherwise="other",
    )


def is_transient(messages: Column) -> Column:
    return _some(messages, r"(?i)received (429|5\d\d) |failed to fetch|fetch failed|in session after evictions")


def failure_headline(messages: Column) -> Column:
    # Signs of failures and the sentences for them.
    return _first(
        (_some(messages, "^not a valid CID$"), "not a valid CID"),
        (_some(messages, "did not match multihash"), "gateway returned bytes that do not match the CID — switch gateway"),
        (_some(messages, r"received (429|5\d\d) "), "gateway kept timing out on a block — likely not cached there; retry, or switch gateway"),
        (_some(messages, "received (404|410) "), "the gateway does not have this content — switch gateway"),
        (_some(messages, "(?i)failed to fetch|networkerror"), "network failure while fetching — check connectivity and retry"),
        (_some(messages, "stopped sending bytes"), "source stalled — not serving this CID right now; retry later"),
        otherwise=F.coalesce(F.get(messages, F.lit(0)), F.lit("failed")),
    )


def failure_detail(messages: Column) -> Column:
    return F.array_join(F.array_distinct(messages), " ← ")


def should_fallback(category: Column) -> Column:
    return category.isin(*RETRIABLE)


def interpret_add_status(http: Column, tx_status: Column, message_ok: Column, added: Column) -> Column:
    """struct(done, ok, reason) of a three-valued add report."""
    seen = ~(http == 404)
    failed = F.coalesce(seen & (tx_status == "failed"), F.lit(False))
    confirmed = F.coalesce(seen & (tx_status == "confirmed"), F.lit(False))
    reverted = confirmed & F.coalesce(~message_ok, F.lit(False))
    good = confirmed & F.coalesce(message_ok, F.lit(False)) & F.coalesce(added, F.lit(False))
    return F.struct((failed | reverted | good).alias("done"), good.alias("ok"), F.when(failed, "tx failed on chain").when(reverted, "AddPieces tx confirmed but reverted (receipt status 0)").alias("reason"))


def fee_level(fee: Column, maximum: int = MAX_FEE) -> Column:
    return _first((fee >= maximum, "spike"), (fee * 10 >= maximum, "rising"), otherwise="ok")


def fee_multiple(fee: Column) -> Column:
    return F.floor(fee / FEE_FLOOR).cast("long")


def profile_name(assets: Column, total_bytes: Column, free_bytes: Column, mbit: Column) -> Column:
    return _first(
        ((assets <= 1000) & (total_bytes.isNull() | (total_bytes < 5 * GIB)), "Laptop tester"), (F.coalesce(mbit < 50, F.lit(False)), "Bandwidth-bound migrator"),
        ((assets >= 100_000) & (F.coalesce(free_bytes, F.lit(0)) >= 4 * 32 * GIB), "Production migrator"), otherwise="SMB / small studio",
    )


def match_profile(assets: Column, total_bytes: Column, free_bytes: Column, mbit: Column) -> Column:
    """struct(name, reasons, knobs) of the first profile whose limits hold; knobs are what a job of that kind is run with."""
    name = profile_name(assets, total_bytes, free_bytes, mbit)
    size = F.when(total_bytes.isNull(), "size unknown, treated as small").otherwise(F.concat(F.lit("estimated "), F.format_string("%.1f", total_bytes / GIB), F.lit(" GiB")))
    reasons = (
        F.when(name == "Laptop tester", F.array(F.lit("at most 1000 ids"), size))
        .when(name == "Bandwidth-bound migrator", F.array(F.concat(F.lit("upload of "), F.format_string("%.0f", mbit), F.lit(" Mbit/s is below 50"))))
        .when(name == "Production migrator", F.array(F.concat(assets.cast("string"), F.lit(" ids are at least 100000")), F.concat(F.lit("free space of "), F.format_string("%.0f", free_bytes / GIB), F.lit(" GiB is at least 128"))))
        .otherwise(F.array(F.lit("no other profile fits")))
    )
    knobs = F.struct(
        in_flight_of(name).alias("max_in_flight"), F.lit("32GiB").alias("piece_size"), F.lit(32).alias("pull_batch"),
        F.when(name == "Laptop tester", "cloudflared").otherwise("funnel").alias("ingress"), F.lit("recommended").alias("car_store"),
    )
    return F.struct(name.alias("name"), reasons.alias("reasons"), knobs.alias("knobs"))


def in_flight_of(profile: Column) -> Column:
    return F.when(profile == "Production migrator", 4).otherwise(1)


def cache_mode(in_flight: Column, free_bytes: Column, failure_rate: Column) -> Column:
    need = in_flight.cast("long") * 32 * GIB + HEADROOM
    return _first((failure_rate > PROBE_FAILURES, "required"), (free_bytes.isNull() | (free_bytes >= need), "recommended"), otherwise="stream-only")


def cache_warnings(in_flight: Column, free_bytes: Column, failure_rate: Column) -> Column:
    """Why the cache mode is what it is; empty where it is as the profile has it and the free space is known."""
    mode = cache_mode(in_flight, free_bytes, failure_rate)
    need = in_flight.cast("long") * 32 + HEADROOM // GIB
    percent = F.format_string("%.0f", F.floor(failure_rate * 100 + 0.5).cast("double"))
    return F.array_compact(F.array(
        F.when(mode == "required", F.concat(F.lit("failure rate of "), percent, F.lit(f"% is above {round(PROBE_FAILURES * 100)}%: the cached path is required"))),
        F.when((mode != "required") & free_bytes.isNull(), "free space is unknown"),
        F.when(mode == "stream-only", F.concat(F.lit("free space of "), F.format_string("%.0f", free_bytes / GIB), F.lit(" GiB is below the "), need.cast("string"), F.lit(" GiB for "), in_flight.cast("string"), F.lit(" in flight"))),
    ))


def source_warnings(probes: Column, deterministic: Column, p50_ms: Column, mbit: Column) -> Column:
    """What an analysis warns of beside the cache: answers that vary, slow ones, and an upload that wasn't measured."""
    varying = probes - F.floor(deterministic * probes + 0.5)
    return F.array_compact(F.array(
        F.when((deterministic < 1) & (probes > 0), F.concat(F.lit("answers varied on "), varying.cast("string"), F.lit(" of "), probes.cast("string"), F.lit(" probes"))),
        F.when(p50_ms > SLOW_MS, F.concat(F.lit("median latency of "), p50_ms.cast("string"), F.lit(f" ms is above {SLOW_MS}"))),
        F.when(mbit.isNull(), "upload wasn't measured"),
    ))


def padded_size(raw: Column) -> Column:
    """Least power of two, 128 at least, whose 127/128 holds raw bytes."""
    need = F.greatest(F.ceil(raw.cast("decimal(20,0)") * 128 / 127).cast("long"), F.lit(128).cast("long"))
    bits = F.length(F.bin(need - 1))
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def tree_height(raw: Column) -> Column:
    return (F.length(F.bin(padded_size(raw))) - 6).cast("int")


def padding(raw: Column) -> Column:
    return (padded_size(raw) / 128).cast("long") * 127 - raw


_SIZE = r"^(\d+)\s*([a-z]*)$"


def _size_parts(text: Column) -> tuple[Column, Column, Column]:
    """The number's digits and the unit, both empty where the text is no size, and the unit's power of two, null where it is unknown."""
    t = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    unit = F.regexp_extract(t, _SIZE, 2)
    return F.regexp_extract(t, _SIZE, 1), unit, F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])[unit]


def parse_size(text: Column) -> Column:
    """Bytes of a size such as 32GiB; null where size_error says why not."""
    value, _, shift = _size_parts(text)
    n = value.try_cast("long")
    return F.when((value != "") & (n <= F.call_function("shiftright", F.lit((1 << 63) - 1), shift)), F.call_function("shiftleft", n, shift))


def size_error(text: Column) -> Column:
    """Why a text is no size of at most 63 bits; null where it is one, or is null."""
    value, unit, shift = _size_parts(text)
    said = _first(
        (value == "", F.concat(F.lit("invalid size: "), text)),
        (shift.isNull(), F.concat(F.lit('unknown size unit "'), unit, F.lit('" in '), text)),
        (parse_size(text).isNull(), F.concat(F.lit("size out of range: "), text)),
        otherwise=F.lit(None).cast("string"),
    )
    return F.when(text.isNotNull(), said)


def format_bytes(n: Column) -> Column:
    of = lambda unit, name: F.concat(F.format_string("%.2f", n / unit), F.lit(name))
    return F.when(n >= GIB, of(GIB, " GiB")).when(n >= MIB, of(MIB, " MiB")).when(n >= KIB, of(KIB, " KiB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_duration(ms: Column) -> Column:
    s = ms / 1000.0
    s = F.when((s * 4) % 2 == 1, s + 0.01).otherwise(s)  # a tie goes up; format_number would take the even digit
    return F.when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms"))).otherwise(F.concat(F.call_function("format_number", s, F.lit("0.0")), F.lit("s")))


def format_rate(n: Column, ms: Column) -> Column:
    return F.when(ms <= 0, "—").otherwise(F.concat(F.format_string("%.2f", n / MIB / (ms / 1000.0)), F.lit(" MiB/s")))


def format_token(amount: Column) -> Column:
    """An 18-decimal amount with four decimals, cut off."""
    ten = "decimal(38,0)"
    whole = F.expr("0").cast(ten) + F.floor(amount / F.lit("1000000000000000000").cast(ten)).cast(ten)
    part = F.floor((amount - whole * F.lit("1000000000000000000").cast(ten)) / F.lit("100000000000000").cast(ten))
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), 4, "0"))


def canonical_url(source: Column, cid: Column) -> Column:
    return F.concat(F.regexp_replace(source, "/+$", ""), F.lit("/ipfs/"), cid, F.lit("?format=car&dag-scope=all&car-version=1&car-order=dfs&car-dups=n"))


def raw_block_url(source: Column, cid: Column) -> Column:
    return F.concat(F.regexp_replace(source, "/+$", ""), F.lit("/ipfs/"), cid, F.lit("?format=raw"))


def relay_url(base: Column, host: Column, cid: Column, piece: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(base, "/+$", ""), F.lit("r"), host, cid, F.lit("piece"), piece)


def _relayed(relay: Column) -> Column:
    return F.coalesce(relay, F.lit("")) != ""


def _host(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://([^/:?#@]+)", 1)


def pull_source_url(base: Column, relay: Column, url: Column, cid: Column, piece: Column) -> Column:
    """Through the relay if there is one, else base/piece/commitment; null where pull_source_error says why not."""
    host = _host(url)
    return F.when(_relayed(relay), F.when(host != "", relay_url(relay, host, cid, piece))).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/piece/"), piece))


def pull_source_error(relay: Column, url: Column, piece: Column) -> Column:
    """Why a sub-piece can't be pulled through the relay; null where it can, or where there is no relay."""
    none = F.coalesce(url, F.lit("")) == ""
    said = F.when(none, F.concat(F.lit("sub-piece "), piece, F.lit(" has no gateway URL"))).when(_host(url) == "", F.concat(F.lit("sub-piece "), piece, F.lit(" has an invalid URL")))
    return F.when(_relayed(relay), said)


def explorer_url(data_set: Column, piece: Column) -> Column:
    base = F.concat(F.lit("https://explorer.example/dataset/"), data_set.cast("string"))
    return F.when(piece.isNull(), base).otherwise(F.concat(base, F.lit("/piece/"), piece.cast("string")))


def piece_of_path(path: Column) -> Column:
    """The sub-piece that a local pull of /piece/<number> asks for, null for other paths."""
    return F.when(path.rlike("^/piece/[0-9]{1,18}$"), F.substring(path, 8, 20).cast("long"))
