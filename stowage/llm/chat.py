"""Conversations as budgeted training windows with loss masks.

Prefix sums of turn tokens say how many turns fit a window: beginning with a
turn, a window takes turns as long as they, the system turn and a little history
together stay within the budget. System and history turns are repeats, and only
the assistant turns that are a window's own carry loss, so a repeated target is
masked.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import cut

#: Tokens of a whole window, and turns repeated before its own at most.
BUDGET, HISTORY = 1024, 2
#: Turns whose prefix sums and windows one task makes; prefix sums of such stretches are added up, and a window never crosses two.
STRETCH = 256

# The template. Text never holds a bare "<" or "&".
BEGIN, OPEN, END_ROLE, CLOSE = "<s>", "<|", "|>", "</s>\n"
_TURN = re.compile(r"<\|(.*?)\|>(.*?)</s>\n", re.S)


def escape(text: Column) -> Column:
    """Text in which no control string of this or another template can be read: & < > [ ] | become references. Reversible."""
    for bare, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lsq;"), ("]", "&rsq;"), ("|", "&bar;")):
        text = F.replace(text, F.lit(bare), F.lit(reference))
    return text


def unescape(text: str) -> str:
    for bare, reference in (("|", "&bar;"), ("]", "&rsq;"), ("[", "&lsq;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = text.replace(reference, bare)
    return text


def _pieces(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(END_ROLE), escape(text), F.lit(CLOSE))


def _counted(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bpe.codec(ranks.value, pattern)
        for batch in batches:
            n = [c.count(c.split.findall(t)) for t in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("conv_id", "turn", "role", "text")), pa.array(n, pa.int64())], ["conv_id", "turn", "role", "text", "tokens"])

    return run


def placed_turns(conversations: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(conv_id, at, before, tokens, role, text): each turn's number from 0, the tokens of the turns before it, and its own.

    Turns are in order of turn, role, text, nulls first and null role and text
    as empty. A turn's tokens are those of its formatted form, encoded by
    itself. Long conversations are summed in stretches of turn numbers; only
    rows with one turn number, or without one, are ordered by a single task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    base = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), _pieces(role, text).alias("piece"))
    base = base.mapInArrow(_counted(bpe.ranks(conversations.sparkSession, vocabulary), pattern), "conv_id long, turn long, role string, text string, tokens long")
    base = cut(base.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 60))).cast("long")))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    inside = Window.partitionBy("conv_id", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = base.groupBy("conv_id", "stretch").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    placed = base.withColumn("sum", F.sum("tokens").over(inside)).withColumn("rank", F.count("*").over(inside))
    joined = placed.join(offsets, placed["conv_id"].eqNullSafe(offsets["c"]) & (placed["stretch"] == offsets["s"]))
    return joined.select("conv_id", (F.col("n0") + F.col("rank") - 1).alias("at"), (F.col("t0") + F.col("sum") - F.col("tokens")).alias("before"), "tokens", "role", "text")


def window_starts(turns: DataFrame, system: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv_id, at, window, past): the window of each turn, named by the turn that begins it, and the first turn that it repeats as history.

    turns (conv_id, at, before, tokens), system (c, system_at, system_tokens).
    From its first turn on a window takes turns while they and what it repeats
    stay within budget. It repeats the system turn always, and of the `history`
    turns before it as many as fit beside it and its first turn and take no more
    than a quarter of the budget. A turn that alone is beyond that has a window
    of its own without history. Each stretch of turns is one small array.
    """
    stretches = F.array_distinct(F.array(*(F.floor((F.col("at") + k) / STRETCH) for k in range(history + 1))))
    rows = turns.select("conv_id", F.explode(stretches).alias("stretch"), F.struct("at", "before", "tokens").alias("t"))
    lists = rows.groupBy("conv_id", "stretch").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    lists = lists.join(system, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    repeated = "IF(coalesce(system_at < t.at, false), system_tokens, 0L)"
    cost = "t.before - ts[j - k].before - IF(coalesce(system_at >= t.at - k AND system_at < t.at, false), system_tokens, 0L)"
    back = f"array_max(filter(sequence(0, {history}), k -> k <= j AND {cost} <= greatest(0L, least({budget // 4}L, {budget} - {repeated} - t.tokens))))"
    with_past = f"transform(ts, (t, j) -> transform(array({back}), k -> named_struct('at', t.at, 'end', t.before + t.tokens, 'limit', t.before + {budget} - {repeated} - ({cost}), 'past', t.at - k))[0])"
    fold = f"""aggregate(filter({with_past}, t -> t.at >= stretch * {STRETCH}),
        named_struct('window', -1L, 'limit', 0L, 'past', 0L, 'out', cast(array() as array<struct<at:bigint,window:bigint,past:bigint>>)),
        (acc, t) -> IF(acc.window >= 0 AND t.end <= acc.limit,
            named_struct('window', acc.window, 'limit', acc.limit, 'past', acc.past, 'out', array_append(acc.out, named_struct('at', t.at, 'window', acc.window, 'past', acc.past))),
            named_struct('window', t.at, 'limit', t.limit, 'past', t.past, 'out', array_append(acc.out, named_struct('at', t.at, 'window', t.at, 'past', t.past)))),
        acc -> acc.out)"""
    return lists.select("conv_id", F.explode(F.expr(fold)).alias("x")).select("conv_id", "x.*")


def windows(conversations: DataFrame, vocabulary: str, pattern: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_context, n_tokens, formatted, loss): formatted windows; loss has the character ranges [a, b) that carry loss.

    window is the number of its first own turn. The first n_context turns of a
    window are repeats: the conversation's first system turn, then at most
    `history` turns before the window; see window_starts. n_tokens counts all of
    it and is within budget, but for a window of a single own turn that is too
    long beside the system turn. Other columns are not read.
    """
    turns = cut(placed_turns(conversations, vocabulary, pattern))
    opening = bpe.codec(vocabulary, pattern).count([BEGIN])
    system = turns.where("role = 'system'").groupBy(F.col("conv_id").alias("c")).agg(F.min(F.struct("at", "tokens", "text")).alias("x"))
    system = cut(system.select("c", F.col("x.at").alias("system_at"), F.col("x.tokens").alias("system_tokens"), F.col("x.text").alias("system_text")))
    plan = cut(window_starts(turns.select("conv_id", "at", "before", "tokens"), system.drop("system_text"), budget - opening, history))

    def with_turns(places: DataFrame, part: int) -> DataFrame:
        found = places.withColumnRenamed("conv_id", "c").withColumnRenamed("at", "p").join(turns, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("at")))
        return found.select("conv_id", "window", F.lit(part).alias("part"), "at", "tokens", "role", "text")

    own = with_turns(plan.select("conv_id", "at", "window"), 2)
    starts = plan.where("at = window")
    past = with_turns(starts.where("past < window").select("conv_id", "window", F.explode(F.sequence(F.col("past"), F.col("window") - 1)).alias("at")), 1)
    kept = starts.join(system, F.col("conv_id").eqNullSafe(F.col("c"))).where("window > system_at")
    kept = kept.select("conv_id", "window", F.lit(0).alias("part"), F.col("system_at").alias("at"), F.col("system_tokens").alias("tokens"), F.lit("system").alias("role"), F.col("system_text").alias("text"))
    rows = own.union(past).union(kept).withColumn("text", escape(F.col("text"))).withColumn("role", escape(F.col("role")))
    grouped = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("part", "at", "tokens", "role", "text"))).alias("turns"))
    # A system turn that is history already isn't repeated twice.
    grouped = grouped.withColumn("turns", F.filter("turns", lambda t: ~((t["part"] == 1) & F.exists("turns", lambda s: (s["part"] == 0) & (s["at"] == t["at"])))))
    pieces = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(END_ROLE), t["text"], F.lit(CLOSE)))
    head = lambda t: F.length(t["role"]) + len(OPEN + END_ROLE)
    size = lambda t: head(t) + F.length(t["text"]) + len(CLOSE)
    start = F.struct(F.lit(len(BEGIN)).alias("p"), F.array().cast("array<struct<a:int,b:int>>").alias("s"))
    step = lambda acc, t: F.struct(
        (acc["p"] + size(t)).alias("p"),
        F.when((t["part"] == 2) & (t["role"] == "assistant"), F.array_append(acc["s"], F.struct((acc["p"] + head(t)).alias("a"), (acc["p"] + head(t) + F.length(t["text"])).alias("b")))).otherwise(acc["s"]).alias("s"),
    )
    return grouped.select("conv_id", "window", F.size(F.filter("turns", lambda t: t["part"] < 2)).alias("n_context"), F.aggregate("turns", F.lit(opening).cast("long"), lambda acc, t: acc + t["tokens"]).alias("n_tokens"), F.concat(F.lit(BEGIN), F.array_join(pieces, "")).alias("formatted"), F.aggregate("turns", start, step)["s"].alias("loss"))


def read_window(formatted: str, n_context: int) -> list[tuple[str, str]]:
    """(role, text) of a window's own turns."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted[len(BEGIN) :])[n_context:]]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation from its windows, which arrive in order; holds one window at a time."""
    state: list | None = None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def done(rows: list[list]) -> pa.RecordBatch:
        values = [[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        finished = []
        for conv, n_context, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_context", "formatted", "loss"))):
            if state is None or state[0] != conv:
                if state is not None:
                    finished.append(state)
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_window(formatted, n_context):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["a"] : span["b"]])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(formatted)
        yield done(finished)
    if state is not None:
        yield done([state])


def window_digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from windows.

    A conversation's windows pass one task in order, as its digests need, but
    stream through it. An empty table gives an empty result.
    """
    ordered = formatted.select("conv_id", "window", "n_context", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
