"""Quality by attention-based multiple-instance learning (Ilse, Tomczak and Welling, 2018).

A text is a bag of passages of PASSAGE words. Each passage is encoded from the
shares of its characters and the shapes and repeats of its words; a layer that
is learned makes a short vector of that, gated attention weighs the vectors,
and the weighted sum is scored. All weights are learned together from labels of
whole documents. Attention is summed up as passages come, so a text of any
length takes as much memory as one slice of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

#: Labelled rows the model is fitted on at most, a hashed sample of all of them, and passages of these: the first rows by hash that keep within it.
FIT_ROWS, FIT_PASSAGES = 3_000, 60_000
PASSAGE, SLICE = 64, 1 << 19
WIDTH, GATE, STEPS, RATE, DECAY = 12, 6, 160, 0.04, 2e-4
THRESHOLD = 0.3

# The characters that are counted together.
GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\f\r", "\n", ".", ",", "!", "?", ";:", "\"'`", "#", "$", "%", "&", "*", "|", "<>", "()[]{}", "-_", "/\\", "=+~^@"]
N_GROUPS = len(GROUPS) + 3
_GROUP = np.full(256, len(GROUPS), np.int64)  # other ASCII
_GROUP[128:192], _GROUP[192:] = len(GROUPS) + 1, len(GROUPS) + 2
for _k, _chars in enumerate(GROUPS):
    _GROUP[list(_chars.encode())] = _k
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\f\r")] = True
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)
FEATURES = N_GROUPS + 9


def _encoded(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """One row for each passage of words starts to ends of raw; passage is each word's, ascending from 0."""
    n = int(passage[-1]) + 1
    raw, starts, ends = raw[starts[0] :], starts - starts[0], ends - starts[0]
    first = np.searchsorted(passage, np.arange(n))
    bounds = np.append(starts[first], len(raw))
    sizes = np.diff(bounds)
    counts = np.bincount(np.repeat(np.arange(n), sizes) * N_GROUPS + _GROUP[raw], minlength=n * N_GROUPS).reshape(n, N_GROUPS)
    words = np.bincount(passage, minlength=n).astype(np.float64)
    length = ends - starts
    within = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
    spelled = np.where(_SPACE[raw], np.uint64(0), lower * _POWERS[within & 63])
    word = np.add.reduceat(spelled, starts)
    group = _GROUP[raw]
    upper = np.add.reduceat((group == 1).astype(np.int64), starts)
    letters = np.add.reduceat(((group <= 1) | (group > len(GROUPS))).astype(np.int64), starts)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(passage, weights=flags, minlength=n) / words

    def fresh(keys: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, passage))
        same = (keys[order][1:] == keys[order][:-1]) & (passage[order][1:] == passage[order][:-1])
        out = np.ones(len(keys))
        out[order[1:][same]] = 0
        return out

    follows = np.append(False, passage[1:] == passage[:-1])
    before = np.where(follows, np.append(np.uint64(0), word[:-1]), np.uint64(0))
    shapes = np.column_stack([
        words / PASSAGE, np.log1p(share(length)), share(length >= 12), share(length == 1), share(letters == 0), share((upper == letters) & (letters > 1)),
        share(fresh(word)), share((word == before) & follows), share(fresh(word * np.uint64(31) + before)),
    ])
    return np.column_stack([np.sqrt(counts / sizes[:, None]), shapes])


def passages(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, features) of the passages of all texts in order, a slice at a time; a text without words has one passage of zeros."""
    held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        raw = np.concatenate([h[1] for h in held])
        at = np.cumsum([0, *(len(h[1]) for h in held[:-1])])
        starts = np.concatenate([h[2] + a for h, a in zip(held, at)])
        ends = np.concatenate([h[3] + a for h, a in zip(held, at)])
        number = np.concatenate([np.arange(len(h[2])) // PASSAGE for h in held])
        owner = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
        new = np.append(True, (number[1:] != number[:-1]) | (owner[1:] != owner[:-1]))
        passage = np.cumsum(new) - 1
        return np.array([held[o][0] for o in owner[new]]), _encoded(raw, starts, ends, passage)

    for k, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        some = False
        while True:
            take = SLICE
            while True:  # whole passages, however long their words are
                part = raw[:take]
                blank = _SPACE[part]
                edge = np.diff(np.concatenate([[1], blank.astype(np.int8), [1]]))
                starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
                if take >= len(raw) or len(starts) > PASSAGE:
                    break
                take *= 2
            rest = None
            if take < len(raw):
                whole = (len(starts) - 1) // PASSAGE * PASSAGE
                rest, part = raw[starts[whole] :], part[: starts[whole]]
                starts, ends = starts[:whole], ends[:whole]
            if len(starts):
                some = True
                held.append((k, part, starts, ends))
                size += len(part)
                if size >= SLICE:
                    yield flush()
                    held, size = [], 0
            if rest is None:
                break
            raw = rest
        if not some:
            if held:
                yield flush()
                held, size = [], 0
            yield np.array([k]), np.zeros((1, FEATURES))
    if held:
        yield flush()


@dataclass(frozen=True)
class Model:
    """Means and scales of the features and the weights: passage layer, both halves of the gate, attention, output."""

    mean: np.ndarray
    scale: np.ndarray
    layer: np.ndarray
    gate: np.ndarray
    mask: np.ndarray
    attention: np.ndarray
    out: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, attention logits) of passages."""
        h = np.tanh(_with_one((x - self.mean) / self.scale) @ self.layer)
        one = _with_one(h)
        return h, (np.tanh(one @ self.gate) / (1 + np.exp(-one @ self.mask))) @ self.attention


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def learn(x: np.ndarray, bag: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> Model:
    """A model of passages x, ordered by bag, and the bags' labels y, by Adam over all of them; without both labels every score is the smoothed share of label 1."""
    rng = np.random.default_rng(seed)
    n, width = len(y), x.shape[1]
    first = np.searchsorted(bag, np.arange(n))
    shape = {"layer": (width + 1, WIDTH), "gate": (WIDTH + 1, GATE), "mask": (WIDTH + 1, GATE), "attention": (GATE,), "out": (WIDTH + 1,)}
    if not 0 < y.sum() < n:
        share = (y.sum() + 0.5) / (n + 1.0)
        none = {k: np.zeros(s) for k, s in shape.items()}
        none["out"][-1] = math.log(share / (1 - share))
        return Model(np.zeros(width), np.ones(width), **none)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = _with_one((x - mean) / scale)
    w = {k: rng.normal(0, 1 / math.sqrt(s[0]), s) for k, s in shape.items()}
    w["out"][-1] = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    past = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    for step in range(1, steps + 1):
        h = np.tanh(z @ w["layer"])
        one = _with_one(h)
        t, s = np.tanh(one @ w["gate"]), 1 / (1 + np.exp(-one @ w["mask"]))
        logit = (t * s) @ w["attention"]
        e = np.exp(logit - np.maximum.reduceat(logit, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        pooled = np.add.reduceat(a[:, None] * h, first)
        p = 1 / (1 + np.exp(-np.clip(pooled @ w["out"][:-1] + w["out"][-1], -30, 30)))
        d = (p - y) / n
        grad = {"out": np.append(d @ pooled, d.sum())}
        dpooled = d[:, None] * w["out"][:-1]
        da = (dpooled[bag] * h).sum(axis=1)
        dlogit = a * (da - np.add.reduceat(a * da, first)[bag])
        grad["attention"] = dlogit @ (t * s)
        dts = dlogit[:, None] * w["attention"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        grad["gate"], grad["mask"] = one.T @ dt, one.T @ ds
        dh = a[:, None] * dpooled[bag] + dt @ w["gate"][:-1].T + ds @ w["mask"][:-1].T
        grad["layer"] = z.T @ (dh * (1 - h * h))
        rate = RATE * (1 + math.cos(math.pi * step / steps)) / 2
        for k, g in grad.items():
            g = g + DECAY * w[k]
            m, v = past[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model(mean, scale, **w)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels = batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist()
        for owner, x in passages(batch.column("text").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in owner], pa.int64()), pa.array([labels[k] for k in owner], pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "features"])


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, most_passages: int = FIT_PASSAGES) -> Model:
    """A model from labelled rows that aren't held out.

    What reaches the driver are the features of at most most_passages passages
    of at most about `most` texts, taken by a hash of doc_id; a text counts as
    many passages as it has words / PASSAGE and is in whole or not at all.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    take = hash_sample(usable, "doc_id", most, usable.count(), "fit").toPandas()
    ids = F.broadcast(docs.sparkSession.createDataFrame(take.astype("int64"), "doc_id long, quality int"))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").dropDuplicates(["doc_id"])
    sized = rows.select("doc_id", (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) / PASSAGE + 1).alias("n"), F.xxhash64("doc_id", F.lit("fit")).alias("h")).toPandas().sort_values(["h", "doc_id"])
    fits = sized[sized["n"].fillna(1).cumsum() <= most_passages]
    few = F.broadcast(docs.sparkSession.createDataFrame(fits[["doc_id"]].astype("int64"), "doc_id long"))
    found = rows.join(few, "doc_id").mapInArrow(_bags, "doc_id long, quality int, features array<double>").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    bag = found["doc_id"].rank(method="dense").to_numpy(dtype=np.int64) - 1
    x = np.array(found["features"].tolist(), np.float64).reshape(-1, FEATURES)
    y = found.drop_duplicates("doc_id")["quality"].to_numpy(dtype=np.float64)
    return learn(x, bag, y)


@dataclass
class _Pool:
    """Attention summed up as passages come: the greatest logit, the weights' sum, the weighted vectors, and the passage that weighs most."""

    top: float = -math.inf
    total: float = 0.0
    vector: np.ndarray | float = 0.0
    n: int = 0
    best: int = 0

    def add(self, h: np.ndarray, logit: np.ndarray) -> None:
        most = int(logit.argmax())
        if logit[most] > self.top:
            self.best = self.n + most
            shrink = math.exp(self.top - logit[most]) if self.n else 0.0
            self.total, self.vector, self.top = self.total * shrink, self.vector * shrink, float(logit[most])
        e = np.exp(logit - self.top)
        self.total, self.vector, self.n = self.total + e.sum(), self.vector + e @ h, self.n + len(h)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pools = [_Pool() for _ in range(batch.num_rows)]
            for owner, x in passages(batch.column("text").to_pylist()):
                h, logit = model.encode(x)
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                for a, z in zip(first, np.append(first[1:], len(owner))):
                    pools[owner[a]].add(h[a:z], logit[a:z])
            z = np.array([p.vector / p.total for p in pools]).reshape(len(pools), -1)
            score = 1 / (1 + np.exp(-np.clip(z @ model.out[:-1] + model.out[-1], -30, 30)))
            cols = [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array([p.n for p in pools], pa.int64()), pa.array([p.best for p in pools], pa.int64()), pa.array([1 / p.total for p in pools], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "n_passages", "top_passage", "top_weight"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, top_passage, top_weight) for every row of docs (doc_id, text).

    score is 0 to 1, the chance of quality 1; predicted is 1 from THRESHOLD up.
    top_passage is the 0-based place of the passage with the most attention
    and top_weight its weight. Null and blank texts have one passage of
    zeros. held_out tells whether the doc_id was kept from fitting (a null doc_id
    wasn't). Repeated rows are scored each; other columns aren't read.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double, n_passages long, top_passage long, top_weight double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "top_passage", "top_weight")
