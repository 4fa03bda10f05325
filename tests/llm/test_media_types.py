"""The media type of every kind that validates, whatever was declared."""

import struct
import zlib

from stowage.llm import media


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


SAMPLES = {
    "audio/wav": media.to_wav(b"x" * 64),
    "image/png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b""),
    "image/gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(9) + b"\x02\x02\x44\x01\x00\x3b",
    "image/jpeg": bytes.fromhex("ffd8ffc00002ffda000200ffd9"),
    "image/bmp": b"BM" + struct.pack("<IIIIIIH", 58, 0, 54, 40, 1, 1, 1) + bytes(30),
    "audio/flac": b"fLaC\x80\0\0\x22" + bytes(34),
    "audio/ogg": b"OggS\0\x04" + bytes(21),
    "video/mp4": struct.pack(">I", 8) + b"ftyp" + struct.pack(">I", 8) + b"moov",
    "audio/mpeg": b"ID3\x04\0\0" + bytes(4) + b"\xff\xfb",
}
UNKNOWN = {"image/png": "application/octet-stream", "text/plain": "text/plain", None: "application/octet-stream"}


def test_every_kind_corrects_the_declared_type(spark):
    cases = [(data, declared, want) for want, data in SAMPLES.items() for declared in ("image/jpeg", "image/png", "text/plain", None)]
    cases += [(b"no object", declared, want) for declared, want in UNKNOWN.items()]
    df = spark.createDataFrame([(i, 0, bytearray(data), declared) for i, (data, declared, _) in enumerate(cases)], "doc_id long, n_bytes long, media binary, declared string")
    got = {r.doc_id: r.feature.split(";")[0] for r in media.sniff_media(df).collect()}
    assert got == {i: f"type={want}" for i, (_, _, want) in enumerate(cases)}
