"""Toxicity from a weighted finite-state grammar over clauses.

Tokens are tagged insult, threat, target, negation, report, quote or other.
Three weighted transducers read these tags: negation and reported speech lower
the weight of a cue, a target raises it. They are composed into one, whose arcs
carry the product of the weights, and each clause is read by it once. A cue's
path through it gives its weight; the model scores these weights alone. The
insult lexicon and the model are learned from labels, each from its own half.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, hash_sample

#: Labelled rows the model is fitted on at most, a hashed sample of all of them.
FIT_ROWS = 20_000
#: Lexicon: least toxic texts with a feature (or a third of the root of all of them), least smoothed log-odds of it, most entries.
MIN_SUPPORT, MIN_LOG_ODDS, MAX_LEXICON = 3, 2.0, 4096
THRESHOLD = 0.3

# Closed-class words of four languages.
NEGATIONS = "not no never nor without isn't aren't nicht kein keine nie niemals pas jamais ni sans nunca jamás sin tampoco".split()
REPORTS = "said says say told wrote quoted claimed called alleged reported sagte sagt schrieb behauptete dit disait écrit affirme dijo dice escribió afirmó".split()
TARGETS = "you your you're yours they them their he she him her people du dich dir dein ihr euch euer sie vous votre tu toi ton ils elles tú usted ustedes vosotros ellos ellas".split()
THREATS = "kill hurt destroy beat shoot stab burn die murder attack töten umbringen verletzen zerstören tuer frapper détruire blesser mourir matar herir destruir golpear morir".split()

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n\"»«„“”]")
STOPS = frozenset(".!?;\n")
QUOTES = frozenset("\"»«„“”")
PREFIXES = (4, 5, 6, 7)
#: What a path multiplies a cue's weight by for each of these on it, and the weights of a threat; an insult's is its log-odds.
NEGATED, REPORTED, AIMED, THREAT = 0.3, 0.4, 1.5, 0.5
#: Tokens within which a negation turns a cue that follows, and a target aims one that follows or precedes.
NEGATION_SPAN, TARGET_SPAN = 3, 4
TAGS = ("insult", "threat", "target", "neg", "report", "quote", "other")


@dataclass(frozen=True)
class Transducer:
    """Weighted arcs (state, tag read) -> (next state, tag written, weight), one for each state and tag; weights add up along a path."""

    start: object
    arcs: dict[tuple[object, str], tuple[object, str, float]]

    def run(self, tags: list[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for tag in tags:
            state, tag, weight = self.arcs[state, tag]
            out.append((tag, weight))
        return out


def is_cue(tag: str) -> bool:
    return tag.startswith(("insult", "threat"))


def explore(start, read: list[str], arc) -> Transducer:
    """The transducer of the states that are reached from start, where arc(state, tag) gives an arc."""
    arcs, todo = {}, [start]
    while todo:
        state = todo.pop()
        if (state, read[0]) in arcs:
            continue
        for tag in read:
            arcs[state, tag] = arc(state, tag)
            todo.append(arcs[state, tag][0])
    return Transducer(start, arcs)


def compose(first: Transducer, second: Transducer, read: tuple[str, ...] = TAGS) -> Transducer:
    """The transducer that does in one pass what second does with what first writes; its weights are the sums."""

    def arc(state, tag):
        one, two = state
        one, between, w1 = first.arcs[one, tag]
        two, written, w2 = second.arcs[two, between]
        return (one, two), written, w1 + w2

    return explore((first.start, second.start), list(read), arc)


def negation(read: tuple[str, ...]) -> Transducer:
    """The state is for how many tokens more a cue is negated."""

    def arc(left, tag):
        if tag == "neg":
            return NEGATION_SPAN, tag, 0.0
        if is_cue(tag) and left:
            return 0, f"{tag}+negated", math.log(NEGATED)
        return max(left - 1, 0), tag, 0.0

    return explore(0, list(read), arc)


def reported_speech(read: tuple[str, ...]) -> Transducer:
    """After a verb of saying all cues of the clause are reported, after an opening quote those up to the closing one."""

    def arc(state, tag):
        if tag == "quote" and state != "said":
            return ("quoted" if state == "own" else "own"), tag, 0.0
        if tag == "report" and state == "own":
            return "said", tag, 0.0
        if is_cue(tag) and state != "own":
            return state, f"{tag}+reported", math.log(REPORTED)
        return state, tag, 0.0

    return explore("own", list(read), arc)


def targets(read: tuple[str, ...]) -> Transducer:
    """The state is for how many tokens more a target aims the next cue, or is looked for behind the last one.

    A target behind a cue writes "aims": its weight is that of the last cue's path.
    """

    def arc(state, tag):
        recent, open_cue = state
        if tag == "target":
            return (TARGET_SPAN, 0), "aims" if open_cue else tag, math.log(AIMED) if open_cue else 0.0
        if is_cue(tag):
            return ((0, 0), f"{tag}+target", math.log(AIMED)) if recent else ((0, TARGET_SPAN), tag, 0.0)
        return (max(recent - 1, 0), max(open_cue - 1, 0)), tag, 0.0

    return explore((0, 0), list(read), arc)


_CUES = ("insult", "threat")
_AFTER_NEGATION = (*TAGS, *(f"{c}+negated" for c in _CUES))
_AFTER_REPORT = (*_AFTER_NEGATION, *(f"{c}+reported" for c in _CUES), *(f"{c}+negated+reported" for c in _CUES))
NEGATION, REPORT, TARGET = negation(TAGS), reported_speech(_AFTER_NEGATION), targets(_AFTER_REPORT)
#: The whole grammar as one transducer.
CLAUSE = compose(compose(NEGATION, REPORT), TARGET)


def _table(t: Transducer) -> list[dict[str, tuple[int, str, float]]]:
    """Arcs by number of state (0: the start), with weights as factors."""
    number = {t.start: 0}
    for state, _ in t.arcs:
        number.setdefault(state, len(number))
    rows: list[dict] = [{} for _ in number]
    for (state, tag), (following, written, weight) in t.arcs.items():
        rows[number[state]][tag] = (number[following], written, math.exp(weight))
    return rows


_ARCS = _table(CLAUSE)


def clause_paths(tags: list[str], weights: list[float]) -> list[list]:
    """[place, path, weight] of each cue of a clause that the grammar accepts."""
    state, out = 0, []
    for i, tag in enumerate(tags):
        state, written, factor = _ARCS[state][tag]
        if written == "aims":
            out[-1][1] += "+target"
            out[-1][2] *= factor
        elif is_cue(written):
            out.append([i, written, weights[i] * factor])
    return out


class Grammar:
    """Tags tokens by the learned lexicon (token or prefix to weight) and the fixed lists; sums the paths of clauses."""

    def __init__(self, lexicon: dict[str, float]):
        self.whole = {k[1:]: w for k, w in lexicon.items() if k[0] == "="}
        self.starts = {k[1:]: w for k, w in lexicon.items() if k[0] == "^"}
        self.lengths = sorted({len(k) for k in self.starts})
        self.fixed = {w: t for t, ws in (("neg", NEGATIONS), ("report", REPORTS), ("target", TARGETS), ("threat", THREATS)) for w in ws}
        self.memory: dict[str, float] = {}

    def weight(self, token: str) -> float:
        found = self.memory.get(token)
        if found is None:
            found = max([self.whole.get(token, 0.0), *(self.starts.get(token[:n], 0.0) for n in self.lengths if len(token) >= n)])
            if len(self.memory) > 200_000:
                self.memory.clear()
            self.memory[token] = found
        return found

    def clauses(self, text: str) -> tuple[int, list[list[tuple[str, str, float]]]]:
        """(number of tokens, the (token, path, weight) of the cues of each clause that has one)."""
        tokens = TOKEN.findall(text.lower())
        memory, weight, threats = self.memory, self.weight, _THREATS
        cues = [i for i, t in enumerate(tokens) if t in threats or (memory[t] if t in memory else weight(t)) > 0]
        out, done = [], -1
        for i in cues:
            if i <= done:
                continue
            a = b = i
            while a > 0 and tokens[a - 1] not in STOPS:
                a -= 1
            while b + 1 < len(tokens) and tokens[b + 1] not in STOPS:
                b += 1
            done = b
            clause = tokens[a : b + 1]
            weights = [weight(t) for t in clause]
            tags = ["insult" if w > 0 else "quote" if t in QUOTES else self.fixed.get(t, "other") for t, w in zip(clause, weights)]
            weights = [THREAT if tag == "threat" else w for tag, w in zip(tags, weights)]
            out.append([(clause[k], path, w) for k, path, w in clause_paths(tags, weights)])
        return len(tokens), out

    def features(self, text: str) -> list[float]:
        """What the model scores: sums of path weights, none of which a word has by itself."""
        n, found = self.clauses(text)
        sums = [sum(w for _, _, w in c) for c in found]
        strongest: dict[str, float] = {}
        for clause in found:
            for token, _, w in clause:
                strongest[token] = max(strongest.get(token, 0.0), w)
        threats = sum(w for c in found for _, path, w in c if path[0] == "t")
        total, n = sum(sums), max(1, n)
        strong = sum(w for w in strongest.values())
        return [
            math.log1p(total), max(sums, default=0.0), math.log1p(strong), math.log1p(threats), math.log1p(sum(min(s, 1.0) for s in sums)),
            math.log(n), math.log1p(100.0 * total / n), math.log1p(total) * math.log(n) / 10, float(not total),
        ]


_THREATS = frozenset(THREATS)


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - np.array(self.mean)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(z @ np.array(self.weights[1:]) + self.weights[0], -30, 30)))


def _doc_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, n): in how many of the batch's texts each token and prefix occurs."""
    for batch in batches:
        n: Counter[tuple[str, int]] = Counter()
        for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            tokens = {w for w in TOKEN.findall((t or "").lower()) if len(w) > 1}
            keys = {f"={w}" for w in tokens} | {f"^{w[:k]}" for w in tokens for k in PREFIXES if len(w) > k}
            n.update((k, y) for k in keys)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.string()), pa.array([y for _, y in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["feature", "toxic", "n"])


def _grammar_features(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            rows = [grammar.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "features"])

    return run


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """A model from labelled rows that aren't held out, at most about `most` of them, taken by hash.

    One half of the sample makes the lexicon and the other, which the lexicon
    hasn't seen, the weights; what reaches the driver is the lexicon, at most
    MAX_LEXICON entries, and a short feature row for each text of the second
    half. Without labels of both kinds every score is the smoothed share of toxic
    rows.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    take = hash_sample(usable, "doc_id", most, usable.count(), "fit").withColumn("half", half).toPandas()
    ids = F.broadcast(docs.sparkSession.createDataFrame(take.astype("int64"), "doc_id long, toxic int, half int"))
    sample = cut(docs.select("doc_id", "text").join(ids, "doc_id").select("text", "toxic", "half"))
    first = take[take["half"] == 0]
    positive = int(first["toxic"].sum())
    negative = len(first) - positive
    counts = sample.where("half = 0").mapInArrow(_doc_features, "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("t"), F.sum("n").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (positive + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (negative + 1.0))
    support = max(MIN_SUPPORT, round(math.sqrt(positive) / 3))
    best = counts.where(f"t >= {support}").withColumn("w", odds).where(F.col("w") >= MIN_LOG_ODDS).orderBy(F.desc(F.col("w") * F.sqrt("t")), "feature").limit(MAX_LEXICON).collect()
    lexicon = {r["feature"]: float(r["w"]) for r in best}
    rows = sample.where("half = 1").mapInArrow(_grammar_features(lexicon), "toxic int, features array<double>").toPandas()
    drop(sample)
    width = len(Grammar({}).features(""))
    x = np.array(rows["features"].tolist(), dtype=np.float64).reshape(-1, width)
    return Model(lexicon, *_logistic(x, rows["toxic"].to_numpy(dtype=np.float64)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[tuple[float, ...], ...]:
    """Ridge logistic regression by Newton steps: means, scales, weights (intercept first)."""
    width = x.shape[1]
    if not 0 < y.sum() < len(y):
        rate = (y.sum() + 0.5) / (len(y) + 10.0)
        return (0.0,) * width, (1.0,) * width, (math.log(rate / (1 - rate)),) + (0.0,) * width
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(width + 1)
    penalty = np.diag([1e-6] + [ridge] * width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist())


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.lexicon)
        for batch in batches:
            rows = [grammar.features(t or "") for t in batch.column("text").to_pylist()]
            x = np.array(rows, dtype=np.float64).reshape(len(rows), len(model.mean))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text).

    score is 0 to 1; predicted is 1 from THRESHOLD up. Null and empty texts have
    no clause and get the score of a text without cues. held_out tells whether
    the doc_id was kept from fitting (a null doc_id wasn't).
    """
    rows = docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def split_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose text the model predicts toxic; all columns stay."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model.lexicon)
        for batch in batches:
            rows = [grammar.features(t or "") for t in batch.column("text").to_pylist()]
            ok = model.scores(np.array(rows, dtype=np.float64).reshape(len(rows), len(model.mean))) < THRESHOLD
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)
