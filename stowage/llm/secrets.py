"""Secrets in text: patterns with a key or prefix, and random strings told from identifiers by Markov models.

All in Spark SQL functions. Places come from marking: every match is wrapped in
control characters that no pattern can match, the text is split at them, and
lengths add up to positions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, let, running_sums

# The patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGN = 6
#: A run shorter than needed fails wherever it is entered, so the least length may stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Runs of the alphabet that the models judge: at a ratio of about 2.5 a step at most, shorter ones can't reach MIN_RATIO.
CANDIDATE = "[A-Za-z0-9+/_=-]{12,}"
#: Texts that the models are trained on at most, for random strings and for identifiers.
FIT_SECRET_ROWS, FIT_WORD_ROWS = 20_000, 1_000
#: A candidate is a secret from this log-likelihood ratio on, in all and for each step.
MIN_RATIO, MIN_RATIO_STEP = 25.0, 0.9

_OPEN, _BAR, _CLOSE = "\x01", "\x02", "\x03"
_SPANS = "array<struct<start:int,end:int,kind:int>>"


def _clean(text: Column) -> Column:
    """The text with the three marks replaced by another character that no pattern matches."""
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _BAR + _CLOSE, "\x04\x04\x04")


def _marked(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{_OPEN}$0{_BAR}${group}{_CLOSE}"))


def _matches(marked: str, kind: int, least: int = 0, token: bool = False) -> str:
    """Spans of the marked matches, with the matched text's own group at least `least` long; with the text itself if token."""
    parts = f"slice(split({marked}, '{_CLOSE}'), 1, size(split({marked}, '{_CLOSE}')) - 1)"
    pieces = f"""transform({parts}, x -> named_struct('before', char_length(substring_index(x, '{_OPEN}', 1)),
        'match', char_length(substring_index(substring_index(x, '{_OPEN}', -1), '{_BAR}', 1)), 'part', substring_index(x, '{_BAR}', -1)))"""
    ends = running_sums("transform(ps, y -> cast(y.before + y.match as bigint))")
    zipped = f"zip_with(ps, es, (y, e) -> named_struct('start', cast(e - y.match as int), 'end', cast(e as int), 'kind', {kind}, 'token', y.part))"
    both = let("ps", pieces, let("es", ends, zipped))
    shape = "s" if token else "named_struct('start', s.start, 'end', s.end, 'kind', s.kind)"
    none = "cast(array() as array<struct<start:int,end:int,kind:int,token:string>>)" if token else f"cast(array() as {_SPANS})"
    return f"CASE WHEN instr({marked}, '{_OPEN}') > 0 THEN transform(filter({both}, s -> char_length(s.token) >= {least}), s -> {shape}) ELSE {none} END"


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, clean, base): spans of assign, access and hex matches, 0-based code points with exclusive ends."""
    clean = docs.select("doc_id", _clean(F.col("text")).alias("clean"))
    marked = clean.select("doc_id", "clean", _marked(F.col("clean"), ASSIGN, 2).alias("m0"), _marked(F.col("clean"), ACCESS, 0).alias("m1"), _marked(F.col("clean"), HEX, 0).alias("m2"))
    return marked.select("doc_id", "clean", F.array_sort(F.concat(*(F.expr(_matches(*m)) for m in (("m0", 0, MIN_ASSIGN), ("m1", 1), ("m2", 2))))).alias("base"))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(token, random): samples for fit, from hashed samples of the texts of about FIT_SECRET_ROWS and FIT_WORD_ROWS rows.

    The tables have no labels for secrets, so the patterns label: values that
    they match and that hold a digit are random strings, runs of the alphabet in
    texts without any match are ordinary identifiers.
    """
    total = docs.count()
    secret = hash_sample(docs, "doc_id", FIT_SECRET_ROWS, total, "secrets")
    found = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(f"({ACCESS}|{HEX})"), F.lit(1)))
    random = secret.select(F.explode(found).alias("token")).where("length(token) >= 12 and token rlike '[0-9]'")
    plain = hash_sample(docs, "doc_id", FIT_WORD_ROWS, total, "secrets").where(~F.coalesce(F.col("text").rlike(f"{ASSIGN}|{ACCESS}|{HEX}"), F.lit(False)))
    ordinary = plain.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9+/_=-]{4,})"), F.lit(1))).alias("token"))
    return random.select("token", F.lit(True).alias("random")).union(ordinary.select("token", F.lit(False).alias("random")))


def fit(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of one character after another, random string against identifier, row by row of ALPHABET.

    samples (token, random) are labelled strings. A step never seen counts as
    once, so an empty table gives ratios of 0.
    """
    chars = samples.where("length(token) > 1").select("random", F.split("token", "").alias("c"))
    pairs = F.zip_with(F.expr("slice(c, 1, size(c) - 1)"), F.expr("slice(c, 2, size(c) - 1)"), lambda a, b: F.concat(a, b))
    bigrams = chars.select("random", F.explode(pairs).alias("pair")).where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").agg(F.count("*").alias("n"))
    size = len(ALPHABET)
    counts = {True: [1.0] * size * size, False: [1.0] * size * size}
    for r in bigrams.collect():  # at most 2 * len(ALPHABET)^2 rows
        counts[r["random"]][ALPHABET.index(r["pair"][0]) * size + ALPHABET.index(r["pair"][1])] += r["n"]
    out = []
    for a in range(size):
        rows = {k: v[a * size : a * size + size] for k, v in counts.items()}
        # A random string's next character is near any other: shrink towards even odds.
        even = {True: 2.0 * size, False: 0.0}
        p = {k: [(x + even[k] / size) / (sum(v) + even[k]) for x in v] for k, v in rows.items()}
        out += [round(math.log(p[True][b] / p[False][b]), 4) for b in range(size)]
    return out


def _untouched(base: str, tokens: str) -> str:
    """For each token, whether no base span overlaps it: as many base spans begin before its end as end by its start.

    One sorted list of ends, starts and questions and one running count answer
    all of them, so the cost doesn't multiply spans by tokens.
    """
    event = lambda at, rank, add, i: f"named_struct('at', {at}, 'rank', {rank}, 'i', {i}, 'add', cast({add} as bigint))"
    events = f"""array_sort(concat(transform({base}, b -> {event('b.end', 0, 1, -1)}), transform({base}, b -> {event('b.start', 3, 1 << 32, -1)}),
        transform({tokens}, (t, i) -> {event('t.start', 1, 0, 'i')}), transform({tokens}, (t, i) -> {event('t.end', 2, 0, 'i')})))"""
    counted = lambda rank: f"transform(filter(v, x -> x.e.rank = {rank}), x -> x.n)"
    sums = running_sums("transform(ev, e -> e.add)")
    # Tokens are in order and don't overlap, so questions of one rank stay in the order of the tokens.
    answers = f"zip_with({counted(1)}, {counted(2)}, (s, e) -> shiftright(e, 32) = (s & 4294967295))"
    return let("ev", events, let("v", f"zip_with(ev, {sums}, (e, n) -> named_struct('e', e, 'n', n))", answers))


def _ratio(token: str) -> str:
    size = len(ALPHABET)
    codes = f"transform(split({token}, ''), c -> instr('{ALPHABET}', c) - 1)"
    return let("k", codes, f"aggregate(zip_with(slice(k, 1, size(k) - 1), slice(k, 2, size(k) - 1), (a, b) -> ratios[a * {size} + b]), 0D, (acc, x) -> acc + x)")


def secret_spans(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """(doc_id, base, random): the pattern spans, and those of other random strings that touch none of them.

    doc_id may be any key column; null text has no spans. Every run of 12 or
    more characters of the alphabet is judged by the models alone. The cost is
    in proportion to the text, whatever the number of its matches.
    """
    base = base_spans(docs)
    model = docs.sparkSession.createDataFrame([(ratios,)], "ratios array<double>")
    found = base.select("doc_id", "base", _marked(F.col("clean"), CANDIDATE, 0).alias("m3")).join(F.broadcast(model))
    likely = f"filter(cs, x -> {_ratio('x.token')} >= greatest({MIN_RATIO}, {MIN_RATIO_STEP} * (length(x.token) - 1)))"
    free = f"CASE WHEN size(base) = 0 OR size(ls) = 0 THEN ls ELSE {let('free', _untouched('base', 'ls'), 'filter(ls, (x, i) -> free[i])')} END"
    spans = let("cs", _matches("m3", 3, token=True), let("ls", likely, f"transform({free}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))"))
    return found.select("doc_id", "base", F.expr(spans).alias("random"))


def _line(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for every row of docs (doc_id, text).

    Spans are kind:start:end, by start and then by kind, in code points with
    exclusive ends. Null and empty texts have none. Repeated rows are scanned
    each; an empty table gives an empty result.
    """
    rows = secret_spans(docs, fit(labelled_samples(docs)) if ratios is None else ratios)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.concat("base", "random")).alias("spans"), F.size("random").cast("long").alias("n_random"))


def redact(docs: DataFrame, ratios: list[float] | None = None, mask: str = "[secret]") -> DataFrame:
    """docs with every span in text replaced by `mask`; all rows and columns stay."""
    named = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    rows = secret_spans(named, fit(labelled_samples(docs)) if ratios is None else ratios)
    spans = F.array_sort(F.concat("base", "random"))
    fold = """aggregate(spans, named_struct('p', 0, 'out', ''), (acc, s) -> IF(s.end <= acc.p, acc, named_struct('p', s.end,
        'out', concat(acc.out, substr(text, acc.p + 1, greatest(s.start - acc.p, 0)), IF(s.start >= acc.p, {mask}, '')))), acc -> concat(acc.out, substr(text, acc.p + 1)))"""
    out = rows.select("doc_id", spans.alias("spans"), F.col("doc_id.text").alias("text")).withColumn("clean", F.when(F.size("spans") > 0, F.expr(fold.replace("{mask}", "'" + mask.replace("'", "\\'") + "'"))).otherwise(F.col("text")))
    return out.select(*(F.col("clean").alias("text") if c == "text" else F.col(f"doc_id.`{c}`").alias(c) for c in docs.columns))
