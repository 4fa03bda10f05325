"""Byte-level BPE over whole texts by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap. Chunks are
pre-tokenised in parallel. Pre-tokens depend on what lies to their left only
through where they begin, so once two neighbouring chunks have a pre-token
boundary at one place of their overlap, they agree from there on: the left chunk
encodes its pieces up to that place, the right one those after it, each where it
is. Decoding concatenates the ids' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Characters of a chunk beyond its overlap, and of the overlap with the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: Encoded pieces that a task remembers.
REMEMBERED = 50_000


class Codec:
    """Encodes pre-tokens by the lines of a rank file, remembering (number of ids, ids as text, bytes of those ids)."""

    def __init__(self, lines: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern)
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def piece(self, piece: str) -> tuple[int, str, bytes]:
        found = self.known.get(piece)
        if found is None:
            ids = self.encoding.encode_ordinary(piece)
            found = (len(ids), " ".join(map(str, ids)), b"".join([self.bytes_of[i] for i in ids]))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = found
        return found

    def encode(self, pieces: list[str]) -> tuple[int, bytes, bytes]:
        """(number of ids, the ids joined by spaces, the decoded bytes) of consecutive pieces."""
        known = self.known
        try:
            got = [known[p] for p in pieces]
        except KeyError:
            got = [self.piece(p) for p in pieces]
        return sum([x[0] for x in got]), " ".join([x[1] for x in got]).encode(), b"".join([x[2] for x in got])

    def count(self, pieces: list[str]) -> int:
        return sum(self.piece(p)[0] for p in pieces)


_codecs: dict[tuple[int, str], Codec] = {}


def codec(vocabulary: str | bytes, pattern: str) -> Codec:
    """The codec of a rank file's path, or of its bytes."""
    if isinstance(vocabulary, str):
        with open(vocabulary, "rb") as file:
            vocabulary = file.read()
    key = hash(vocabulary), pattern
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary, pattern)
    return _codecs[key]


def ranks(spark: SparkSession, path: str):
    """The rank file's bytes as a broadcast, so that executors need no such file; a vocabulary is of bounded size."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _chunks(chunk: int, overlap: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, row, text in zip(*(batch.column(c) for c in ("doc_id", "row", "text"))):
                text = text.as_py() or ""
                last = max(0, -(-(len(text) - overlap) // chunk) - 1)
                for at in range(0, last + 1, 64):
                    ks = range(at, min(at + 64, last + 1))
                    same = [pa.array([x.as_py()] * len(ks), pa.int64()) for x in (doc_id, row)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(ks, pa.int64()), pa.array([last] * len(ks), pa.int64()), pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in ks], pa.string())], ["doc_id", "row", "k", "last", "text"])

    return split


def chunk_rows(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, row, k, last, text): the chunks of each text; chunk k begins at character k * chunk and reaches overlap characters into the next."""
    # Spark's substring walks from the text's start for each chunk; slices of a Python string don't.
    return docs.select("doc_id", "row", "text").mapInArrow(_chunks(chunk, overlap), "doc_id long, row long, k long, last long, text string")


def boundaries(split: regex.Pattern, text: str, at: int, final: bool) -> list[int]:
    """Ends of the pre-tokens of a chunk that begins at character `at`; without those that the chunk's own end may have cut short."""
    ends = [at + m.end() for m in split.finditer(text)]
    if not final:  # a pre-token may look at what follows: the last two can differ with more text
        ends = ends[:-2]
    return ends


def _digest_rows(ranks, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for t in batch.column("text"):
                n, line, raw = c.encode(c.split.findall(t.as_py() or ""))
                counts.append(n)
                ids.append(hashlib.sha256(line).hexdigest())
                decoded.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode


def _chunk_ends(pattern: str, chunk: int, overlap: int):
    """The pre-token boundaries of each chunk within its overlaps with the chunk before (head) and after (tail)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for t, k, last in zip(*(batch.column(c).to_pylist() for c in ("text", "k", "last"))):
                ends = boundaries(split, t, k * chunk, k == last)
                heads.append([e for e in ends if k * chunk < e <= k * chunk + overlap])
                tails.append([e for e in ends if e > (k + 1) * chunk])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "k")), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["row", "k", "head", "tail"])

    return find


def stitched(ends: DataFrame) -> DataFrame:
    """(row, run, first, final, begins, stops): runs of chunks, and the characters between which each is encoded.

    Neighbours join at the last boundary that both have (null stops: the text's
    end). Chunks without a common boundary, as in a run of one character class
    longer than the overlap, are one run, which is pre-tokenised as a whole.
    Only the boundaries within overlaps meet, never texts.
    """
    order = Window.partitionBy("row").orderBy("k")
    joins = ends.select("row", "k", F.array_max(F.array_intersect("tail", F.lead("head").over(order))).alias("stops"))
    own = joins.withColumn("begins", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.lag("stops").over(order)))
    runs = own.withColumn("run", F.sum(F.when(F.col("begins").isNotNull(), 1).otherwise(0)).over(order))
    return runs.groupBy("row", "run").agg(F.min("k").alias("first"), F.max("k").alias("final"), F.max("begins").alias("begins"), F.max_by("stops", "k").alias("stops"))


def _pieces_of(split: regex.Pattern, chunk: int, texts: list[str], k: int, begins: int, stops: int | None) -> tuple[list[str], bool]:
    """The pre-tokens of the chunks `texts` from chunk k on between two places of the whole text, and whether one ends at stops."""
    text = "".join([t[:chunk] for t in texts[:-1]] + texts[-1:])
    end = len(text) if stops is None else stops - k * chunk
    # Pre-tokens may look one character ahead, so they are matched with what follows.
    found = [m for m in split.finditer(text, begins - k * chunk) if m.end() <= end]
    return [m[0] for m in found], not found or found[-1].end() == end


def _stops_hold(pattern: str, chunk: int):
    """Whether a run of several chunks, pre-tokenised as a whole, has a boundary where the next run begins."""

    def check(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        one = {c: table.column(c)[0].as_py() for c in ("k", "begins", "stops")}
        _, holds = _pieces_of(regex.compile(pattern), chunk, table.column("text").to_pylist(), **one)
        return pa.table({"row": table.column("row").slice(0, 1), "holds": pa.array([holds])})

    return check


_RUNS = "row long, run long, n long, ids binary, bytes binary"


def _encoded(c: Codec, chunk: int, rows: list[tuple]) -> pa.Table:
    """Encoded runs from (row, run, texts, k, begins, stops)."""
    out = [(row, run, *c.encode(_pieces_of(c.split, chunk, *rest)[0])) for row, run, *rest in rows]
    columns = list(zip(*out)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(x, k) for n, x, k in zip(("row", "run", "n", "ids", "bytes"), columns, kinds)})


def _encoded_chunks(ranks, pattern: str, chunk: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = zip(*(part.column(x).to_pylist() for x in ("row", "run", "text", "k", "begins", "stops")))
                yield from _encoded(c, chunk, [(row, run, [text], *rest) for row, run, text, *rest in rows]).to_batches()

    return encode


def _encoded_runs(ranks, pattern: str, chunk: int):
    def encode(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        row, run, k, begins, stops = (table.column(x)[0].as_py() for x in ("row", "run", "k", "begins", "stops"))
        return _encoded(codec(ranks.value, pattern), chunk, [(row, run, table.column("text").to_pylist(), k, begins, stops)])

    return encode


def runs_of(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """The runs of stitched(), of which each stops at a true boundary.

    The boundaries of a chunk that shares none with the one before it aren't
    certain, so such runs are checked as a whole, and a text of which one fails
    is a single run.
    """
    ends = chunks.select("row", "k", "last", "text").mapInArrow(_chunk_ends(pattern, chunk, overlap), "row long, k long, head array<int>, tail array<int>")
    runs = cut(stitched(ends))
    several = runs.where("first < final AND stops IS NOT NULL")
    if several.isEmpty():
        return runs
    texts = chunks.select("row", "k", "text").join(several.withColumn("k", F.explode(F.sequence("first", "final"))), ["row", "k"])
    failed = cut(texts.groupBy("row", "run").applyInArrow(_stops_hold(pattern, chunk), "row long, holds boolean").where("NOT holds").select("row").distinct())
    whole = runs.join(failed, "row").groupBy("row").agg(F.lit(1).cast("long").alias("run"), F.min("first").alias("first"), F.max("final").alias("final"), F.lit(0).alias("begins"), F.lit(None).cast("int").alias("stops"))
    return cut(runs.join(failed, "row", "left_anti").unionByName(whole))


def _row_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each text from its encoded runs, which arrive in order; holds one batch of them at a time."""
    state: list | None = None

    def done(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].hexdigest() for r in rows], pa.string()), pa.array([r[3].hexdigest() for r in rows], pa.string())], ["row", "n_tokens", "ids_sha256", "decoded_sha256"])

    for batch in batches:
        finished = []
        for row, n, ids, raw in zip(*(batch.column(c) for c in ("row", "n", "ids", "bytes"))):
            row, n, ids, raw = row.as_py(), n.as_py(), ids.as_py(), raw.as_py()
            if state is None or state[0] != row:
                if state is not None:
                    finished.append(state)
                state = [row, 0, hashlib.sha256(), hashlib.sha256()]
            if n:
                state[2].update(b" " + ids if state[1] else ids)
            state[1] += n
            state[3].update(raw)
        yield done(finished)
    if state is not None:
        yield done([state])


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs (doc_id, text).

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the
    bytes that the ids decode to. Null and empty texts have no ids. A text of one
    chunk needs no stitching and is done where it is read; the chunks of a longer
    one are pre-tokenised and encoded by many tasks, and only its digests, which
    are sequential, are made by one, from a stream of encoded chunks. Equal rows
    each give a row; an empty table gives none.
    """
    known = ranks(docs.sparkSession, path)
    longer = F.coalesce(F.length("text"), F.lit(0)) > chunk + overlap
    one = docs.where(~longer).select("doc_id", "text").mapInArrow(_digest_rows(known, pattern), _DIGESTS)
    chunks = cut(chunk_rows(docs.where(longer).select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), chunk, overlap).repartition("row", "k"))
    places = runs_of(chunks, pattern, chunk, overlap)
    texts = chunks.select("row", "k", "text").join(places.withColumn("k", F.explode(F.sequence("first", "final"))), ["row", "k"])
    runs = texts.where("first = final").mapInArrow(_encoded_chunks(known, pattern, chunk), _RUNS)
    runs = runs.union(texts.where("first < final").groupBy("row", "run").applyInArrow(_encoded_runs(known, pattern, chunk), _RUNS))
    ordered = runs.repartition("row").sortWithinPartitions("row", "run")
    digests = ordered.mapInArrow(_row_digests, "row long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    names = chunks.where("k = 0").select("row", "doc_id")
    return one.union(names.join(digests, "row").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))


def _ids(ranks, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value, pattern)
        for batch in batches:
            lists = [[int(x) for x in c.encode(c.split.findall(t))[1].split()] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return encode


def encode_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids themselves, for texts that fit a row."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_ids(ranks(docs.sparkSession, path), pattern), "doc_id long, ids array<int>")


def _bytes(ranks, pattern: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(ranks.value, pattern).bytes_of
        for batch in batches:
            raw = [b"".join([of[i] for i in ids or []]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return decode


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids)."""
    return encoded.select("doc_id", "ids").mapInArrow(_bytes(ranks(encoded.sparkSession, path), pattern), "doc_id long, bytes binary")
