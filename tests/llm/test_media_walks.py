"""False signatures by the thousand, and the feature column against a plain computation."""

import random
import struct
import time
import zlib

import numpy as np
import pytest

from stowage.llm import media
from stowage.llm.common import read

HEADS = {
    "gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x21",
    "jpeg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02x",
    "ogg": b"OggS\0" + bytes(21) + b"\1\1a",
    "mp4": b"\0\0\0\x0cftypmp42",
    "flac": b"fLaC\0\0\0\x22" + bytes(34) + b"\1\0\0\0",
    "png": b"\x89PNG\r\n\x1a\n\0\0\0\0IHDR" + struct.pack(">I", zlib.crc32(b"IHDR")) + b"\0\0\0\x08abcd",
    "wav": b"RIFF\xff\xff\0\0WAVEfmt \4\0\0\0RIFF",
}


@pytest.mark.parametrize("kind", HEADS)
def test_false_heads_are_linear(kind):
    took = []
    for n in (20_000, 80_000):
        began = time.time()
        media.carve(HEADS[kind] * n + b"\1\2")
        took.append(time.time() - began)
    assert took[1] < 12 * max(took[0], 0.05) and took[1] < 20


def test_walks_that_meet_agree_with_each_alone():
    """Every start is judged as if it were the only one."""
    rng = random.Random(2)
    for kind, head in HEADS.items():
        magic = head[: {"gif": 6, "jpeg": 3, "ogg": 4, "mp4": 12, "flac": 8, "png": 8, "wav": 12}[kind]]
        for _ in range(60):
            data = b"".join(rng.choice([head, magic, b"\0", b"\x3b", b"\x2c" + bytes(9), b"\xff\xd9", b"\xff\xc0\0\2", b"\0\0\0\x08moov", b"\0\0\0\0IEND", b"\x84\0\0\0"]) for _ in range(30))
            shared: dict = {}
            walk = media._VALIDATORS[kind]
            for at in range(len(data)):
                if data.startswith(magic[:3], at):
                    assert walk(data, at, shared) == walk(data, at, {})


def test_features(spark, sf_dir, odd_docs):
    for docs in (read(spark, sf_dir, "documents"), odd_docs):
        got = media.media_columns(docs).select("doc_id", "feature").collect()
        want = []
        for r in docs.select("doc_id", "text").collect():
            raw = (r.text or "").encode()
            payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            samples = np.frombuffer(payload, np.uint8)
            above = [x >= 128 for x in payload]
            crossings = sum(a != b for a, b in zip(above, above[1:]))
            feature = f"type=audio/wav;was=application/octet-stream;samples={len(payload)};mean={sum(payload) // len(samples)};crossings={crossings};inner="
            want.append((r.doc_id, feature))
        assert sorted(map(tuple, got)) == sorted(want)
