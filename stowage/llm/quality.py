"""Quality rules per document, and host verdicts from shrunk failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, words_of

MIN_WORDS = 50
#: A document fails when more than this percentage of its words lies in repeated 3-word windows.
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: A host is rejected when its shrunk failure rate, less Z posterior standard deviations, is over this.
MAX_HOST_RATE, Z = 0.5, 2.0
#: Digits of the rate that is returned; verdicts use all of it.
RATE_DIGITS = 6
#: Hosts up to this many are broadcast to the documents; more are joined by a salted shuffle.
BROADCAST_HOSTS = 20_000
SALTS = 32


def _repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice.

    Windows are sorted by digest with their positions; neighbours with one
    digest are repeats. Sorted positions then give the cover without a set: a
    window adds the words beyond the end of the one before it.
    """
    size = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))),
        lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")),
    )
    return F.when(size >= 4, F.array_sort(windows)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def rule_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: doc_id, host, and the counts that the rules use; see quality_verdicts."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.btrim(s, F.lit(SPACES))) > 0)
    base = docs.select(
        "doc_id",
        F.col(host).alias("host"),
        words_of(F.col("text")).alias("words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    sorted_windows = base.select("*", _repeat_words(F.col("words")).alias("w"))
    # Each window next to the one after it in digest order; both ends of an equal pair are repeats.
    pairs = F.zip_with(
        F.expr("slice(w, 1, greatest(size(w) - 1, 0))"),
        F.expr("slice(w, 2, greatest(size(w) - 1, 0))"),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    starts = sorted_windows.select("*", F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))).alias("starts"))
    gaps = F.zip_with(F.expr("slice(starts, 1, greatest(size(starts) - 1, 0))"), F.expr("slice(starts, 2, greatest(size(starts) - 1, 0))"), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("starts") > 0, F.aggregate(gaps, F.lit(3), lambda acc, x: acc + x)).otherwise(0)
    return starts.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )


def host_verdicts(rules: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_rejected) from rows (host, base_failed).

    Failures are counted per host before any shuffle. The beta prior has the
    mean and, by moments, the spread of the hosts' own rates; a host's rate is
    its posterior mean. Hosts without spread share the overall rate.
    """
    hosts = rules.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        (F.sum(F.col("n_docs") * rate * rate) / F.sum("n_docs")).alias("square"),
        (F.count("*") / F.sum(F.lit(1.0) / F.col("n_docs"))).alias("typical"),
    )
    m, spread = F.col("mean"), F.col("square") - F.col("mean") * F.col("mean")
    noise = m * (1 - m) / F.col("typical")
    excess = F.greatest(spread - noise, m * (1 - m) / F.lit(1000.0))
    strength = F.greatest(F.coalesce(m * (1 - m) / F.nullif(excess, F.lit(0.0)) - 1, F.lit(1.0)), F.lit(1.0))
    prior = moments.select(F.coalesce(m, F.lit(0.0)).alias("mean"), F.coalesce(strength, F.lit(1.0)).alias("strength"))
    a, b = F.col("n_failed") + F.col("mean") * F.col("strength"), F.col("n_docs") - F.col("n_failed") + (1 - F.col("mean")) * F.col("strength")
    mean = a / (a + b)
    error = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", F.round(mean, RATE_DIGITS).alias("host_rate"), (mean - Z * error > MAX_HOST_RATE).alias("host_rejected"))


def quality_verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, host_rejected, kept for every row of docs.

    Words are runs of `[^\\x20\\x09-\\x0D]`; a null or blank text has none and
    fails. n_dup_lines counts \\n-split lines with a word that equal an earlier
    one, n_repeat_words the words in 3-word windows found twice or more. A
    document is kept when it passes and its host isn't rejected. Null hosts form
    one host. An empty table gives an empty result; repeated rows are judged
    each; only doc_id, text and the host column are read.
    """
    counts = rule_counts(docs, host)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rules = cut(counts.withColumn("base_failed", failed))
    hosts = cut(host_verdicts(rules)).select("host", "host_rate", "host_rejected")
    if hosts.count() <= BROADCAST_HOSTS:
        joined = rules.alias("r").join(F.broadcast(hosts.alias("h")), F.col("r.host").eqNullSafe(F.col("h.host")), "left")
    else:
        salted = rules.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        spread = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.alias("r").join(spread.alias("h"), F.col("r.host").eqNullSafe(F.col("h.host")) & (F.col("r.salt") == F.col("h.salt")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "host_rejected",
        (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"),
    )
