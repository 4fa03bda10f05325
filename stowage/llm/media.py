"""Texts stored as 8-bit audio samples, and stored bytes sniffed by their signatures.

One Aho-Corasick pass finds every magic number in a stored object; a validator
per format then confirms structure and lengths from the bytes themselves, so a
chance occurrence inside samples is no object, a wrong declared type is
corrected, and objects inside others can be carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Samples per second of stored texts; a payload is a whole number of frames of this many bytes.
RATE, FRAME = 8000, 64

# Magic numbers of the formats and how far into an object each lies.
MAGIC = {
    b"RIFF": ("wav", 0),
    b"\x89PNG\r\n\x1a\n": ("png", 0),
    b"GIF87a": ("gif", 0),
    b"GIF89a": ("gif", 0),
    b"\xff\xd8\xff": ("jpeg", 0),
    b"BM": ("bmp", 0),
    b"fLaC": ("flac", 0),
    b"OggS": ("ogg", 0),
    b"ftyp": ("mp4", 4),
    b"ID3": ("mp3", 0),
}
#: Media type of each kind.
TYPES = {"wav": "audio/wav", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp", "flac": "audio/flac", "ogg": "audio/ogg", "mp4": "video/mp4", "mp3": "audio/mpeg"}
UNKNOWN = "application/octet-stream"


def _follow(step, state, known: dict):
    """The end of the walk state -> step(state) -> ..., which gives an end, a next state or None (a failure).

    What a state leads to is remembered, so walks that run into one another, as
    from false signatures in a row, cost no more than one.
    """
    path = []
    while state not in known:
        path.append(state)
        following = step(state)
        if not isinstance(following, tuple):
            known[state] = -1 if following is None else following
            break
        state = following
    end = known[state]
    known.update(dict.fromkeys(path, end))
    return end


def _wav(b: bytes, at: int, known: dict) -> int:
    """End of the RIFF/WAVE object at `at`: chunks with printable names fill the declared length exactly, fmt and data among them."""
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if b[at + 8 : at + 12] != b"WAVE" or end > len(b):
        return -1

    def step(state):
        p, seen, stop = state
        name = b[p : p + 4]
        if p + 8 > stop:
            return p if p == stop and seen == 3 else None
        if not (name.isascii() and name.decode("ascii").isprintable()):
            return None
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        return (p + 8 + size + size % 2, seen | (name == b"fmt ") | (name == b"data") << 1, stop)

    return _follow(step, (at + 12, 0, end), known)


def _png(b: bytes, at: int, known: dict) -> int:
    """Chunks from IHDR to IEND; only a chain that reaches its end by lengths has its checksums compared, each chunk once."""
    if b[at + 12 : at + 16] != b"IHDR":
        return -1

    def step(state):
        (p,) = state
        size = int.from_bytes(b[p : p + 4], "big")
        if p + 12 + size > len(b):
            return None
        return p + 12 if b[p + 4 : p + 8] == b"IEND" else (p + 12 + size,)

    def sound(state):
        _, p, stop = state
        if p >= stop:
            return stop
        size = int.from_bytes(b[p : p + 4], "big")
        if zlib.crc32(memoryview(b)[p + 4 : p + 8 + size]) != int.from_bytes(b[p + 8 + size : p + 12 + size], "big"):
            return None
        return ("sum", p + 12 + size, stop)

    end = _follow(step, (at + 8,), known)
    return _follow(sound, ("sum", at + 8, end), known) if end > 0 else -1


def _gif(b: bytes, at: int, known: dict) -> int:
    """Blocks up to the trailer, of which one at least is an image."""
    if len(b) < at + 13:
        return -1

    def step(state):
        p, inside, images = state
        if p >= len(b):
            return None
        if inside:  # sub-blocks up to an empty one
            return (p + b[p] + 1, b[p] > 0, images)
        if b[p] == 0x3B:
            return p + 1 if images else None
        if b[p] == 0x21:
            return (p + 2, True, images)
        if b[p] == 0x2C and p + 10 < len(b):
            return (p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 128 else 0), True, True)
        return None

    return _follow(step, (at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0), False, False), known)


def _jpeg(b: bytes, at: int, known: dict) -> int:
    """Segments with their lengths, then coded data up to the next marker, to the end marker; with a frame header before it."""

    def step(state):
        p, coded, frame = state
        if coded:
            p = b.find(b"\xff", p)
            if p < 0 or p + 1 >= len(b):
                return None
            if b[p + 1] == 0xD9:
                return p + 2 if frame else None
            return (p + 2, True, frame) if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7 else (p, False, frame)
        if p + 4 > len(b) or b[p] != 0xFF:
            return None
        kind, size = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if size < 2 or kind in (0x00, 0xD9):
            return None
        return (p + 2 + size, kind == 0xDA, frame or (0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)))

    return _follow(step, (at + 2, False, False), known)


def _bmp(b: bytes, at: int, known: dict) -> int:
    if len(b) < at + 30:
        return -1
    size, _, start, header = struct.unpack_from("<IIII", b, at + 2)
    ok = header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= start <= size and at + size <= len(b) and b[at + 6 : at + 10] == b"\0\0\0\0"
    return at + size if ok and int.from_bytes(b[at + 26 : at + 28], "little") == 1 else -1


def _flac(b: bytes, at: int, known: dict) -> int:
    """STREAMINFO, then metadata blocks up to the last one; frames have no outer length."""
    if len(b) < at + 42 or b[at + 4] & 127 or b[at + 5 : at + 8] != b"\0\0\x22":
        return -1

    def step(state):
        (p,) = state
        size = int.from_bytes(b[p + 1 : p + 4], "big")
        if p + 4 + size > len(b) or p + 4 > len(b) or b[p] & 127 > 6:
            return None
        return len(b) if b[p] & 128 else (p + 4 + size,)

    return _follow(step, (at + 4,), known)


def _ogg(b: bytes, at: int, known: dict) -> int:
    """Pages up to one that says it is the last."""

    def step(p):
        if b[p : p + 4] != b"OggS" or p + 27 > len(b) or b[p + 4]:
            return None
        table = b[p + 27 : p + 27 + b[p + 26]]
        end = p + 27 + b[p + 26] + sum(table)
        if len(table) < b[p + 26] or end > len(b):
            return None
        return end if b[p + 5] & 4 else (end,)

    return _follow(lambda state: step(*state), (at,), known)


def _mp4(b: bytes, at: int, known: dict) -> int:
    """Boxes one after another from ftyp on, moov among them."""

    def step(state):
        p, moov = state
        size, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if p + 8 > len(b) or size < 8 or p + size > len(b) or not kind.isalnum():
            return p if moov else None
        return (p + size, moov or kind == b"moov")

    return _follow(step, (at, False), known) if b[at + 4 : at + 8] == b"ftyp" else -1


def _mp3(b: bytes, at: int, known: dict) -> int:
    size = b[at + 6 : at + 10]
    if len(size) < 4 or max(size) > 127 or b[at + 3] not in (2, 3, 4):
        return -1
    p = at + 10 + (size[0] << 21 | size[1] << 14 | size[2] << 7 | size[3])
    return len(b) if p + 2 <= len(b) and b[p] == 0xFF and b[p + 1] & 0xE0 == 0xE0 else -1


_VALIDATORS = {"wav": _wav, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "flac": _flac, "ogg": _ogg, "mp4": _mp4, "mp3": _mp3}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, (kind, back) in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (kind, back, len(magic)))
    a.make_automaton()
    return a


def carve(stored: bytes, automaton: ahocorasick.Automaton | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each object that validates, in order; one may lie inside another."""
    out = []
    known: dict[str, dict] = defaultdict(dict)
    for end, (kind, back, size) in (automaton or _automaton()).iter(stored.decode("latin-1")):
        start = end + 1 - size - back
        if start >= 0 and (stop := _VALIDATORS[kind](stored, start, known[kind])) > start:
            out.append((kind, start, stop))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def to_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples; a sample is a byte."""
    pad = bytes(len(payload) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload + pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload + pad


def wav_samples(stored: bytes, start: int = 0) -> bytes:
    """The bytes of the data chunk of the RIFF/WAVE object at start."""
    p = start + 12
    while stored[p : p + 4] != b"data":
        p += 8 + int.from_bytes(stored[p + 4 : p + 8], "little") + stored[p + 4] % 2
    return stored[p + 8 : p + 8 + int.from_bytes(stored[p + 4 : p + 8], "little")]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        stored, sizes = [], []
        for t in texts:
            raw = t.as_py() or b""
            sizes.append(len(raw))
            stored.append(to_wav(raw + bytes(max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary()), pa.array(["application/octet-stream"] * len(stored))], ["doc_id", "n_bytes", "media", "declared"])


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, declared): each text's UTF-8 bytes, zero-filled to a positive multiple of 64, as a WAV object. Null is empty."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary, declared string")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for m, declared in zip(batch.column("media"), batch.column("declared").to_pylist()):
            stored = m.as_py() or b""
            objects = carve(stored, automaton)
            outer = objects[0] if objects and objects[0][1] == 0 else ("unknown", 0, len(stored))
            inner = [x for x in objects if x is not outer]
            payload = wav_samples(stored) if outer[0] == "wav" else stored
            samples = np.frombuffer(payload, np.uint8)
            zero = int(np.count_nonzero(np.diff(np.signbit(samples.astype(np.int16) - 128))))
            mean = int(samples.sum(dtype=np.int64)) // max(1, len(samples))
            corrected = TYPES.get(outer[0]) or (UNKNOWN if declared in TYPES.values() else declared or UNKNOWN)
            feature = f"type={corrected};was={declared};samples={len(samples)};mean={mean};crossings={zero};inner={','.join(f'{k}:{a}:{b}' for k, a, b in inner)}"
            for column, value in zip(out, (outer[0], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(stored), hashlib.sha256(stored).hexdigest(), len(inner), feature)):
                column.append(value)
        names = ["kind", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_inner", "feature"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "n_bytes", *names])


def sniff_media(stored: DataFrame) -> DataFrame:
    """Per row of (doc_id, n_bytes, media, declared): the kind that validates, digests of the stored form and of the payload read back from it, and features.

    An object whose signature doesn't validate is of kind "unknown" and its own
    payload; null media is empty. n_inner counts validated objects inside the
    outer one. The feature's type is that of the kind; media of kind "unknown"
    keep a declared type only if it is none that sniffing would have found.
    Equal media give equal values; an empty table an empty result.
    """
    schema = "doc_id long, n_bytes long, kind string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_inner long, feature string"
    return stored.select("doc_id", "n_bytes", "media", "declared").mapInArrow(_read, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Texts stored as media and read back from the stored bytes; see store_texts and sniff_media."""
    return sniff_media(store_texts(docs))
