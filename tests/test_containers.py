"""Containers and manifests: members read back by offset, nothing left by failures, one valid document."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from stowage.sources import containers, tables


def plan(spark, n=60, wrong=None):
    rows, at = [], {}
    for i in range(n):
        key = ("hot" if i % 3 else "g", i % 7 // 3)
        rows.append((*key, i, at.get(key, 0) + (i == wrong), bytes([i]) * (i % 11)))
        at[key] = at.get(key, 0) + i % 11
    df = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], "group string, bin long, id long, offset long, payload binary")
    return df.drop("payload"), df.select("id", "payload"), rows


def test_members_come_back_by_offset(spark, tmp_path):
    bins, payloads, rows = plan(spark)
    index = containers.write_containers(bins, payloads, str(tmp_path))
    back = containers.read_members(index.where("group = 'hot'"), str(tmp_path)).collect()
    want = {str(r[2]): r for r in rows if r[0] == "hot"}
    assert {r.id for r in back} == set(want)
    for r in back:
        group, number, _, offset, payload = want[r.id]
        assert (r.bin, r.offset, r.size, bytes(r.payload), r.sha256) == (number, offset, len(payload), payload, hashlib.sha256(payload).hexdigest())
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith("hot")) == ["g-0.bin", "g-1.bin", "g-2.bin", "index"]
    whole = b"".join(r[4] for r in rows if r[:2] == ("g", 1))
    assert (tmp_path / "g-1.bin").read_bytes() == whole


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bins, payloads, _ = plan(spark, wrong=40)
    with pytest.raises(Exception, match="is planned at"):
        containers.write_containers(bins, payloads, str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_a_lost_attempt_leaves_nothing(tmp_path):
    """Two attempts of one task, of which one breaks off and one isn't committed."""
    import pyarrow as pa

    writer = containers.ContainerWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pylist([{"group": "g", "bin": 0, "id": "a", "offset": 0, "payload": b"xy"}])

    def breaks():
        yield batch
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(breaks())
    writer.write(iter([batch]))  # ended, but came second
    good = writer.write(iter([batch]))
    assert [p.name for p in tmp_path.iterdir()] == [writer.job]
    writer.commit([good, None])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["g-0.bin", "index"] and len(list((tmp_path / "index").iterdir())) == 1
    other = containers.ContainerWriter(str(tmp_path))
    other.abort([other.write(iter([batch]))])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["g-0.bin", "index"]


def document(path):
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


HEAD = {"tool": "t", "network": "calibration", "gateway": "https://g.example"}


def test_one_document_from_many_tasks(spark, tmp_path, many_tasks):
    n = 20_000
    pieces = spark.range(n).select(F.format_string("c%06d", (F.col("id") * 7919) % n).alias("cid"), F.lit("p").alias("piece_cid"), F.col("id").alias("raw_size"), F.when(F.col("id") % 5 > 0, F.lit('u"\n,')).alias("url"))
    tables.write_manifest(pieces, f"{tmp_path}/m", HEAD)
    files = sorted((tmp_path / "m").glob("part-*"))
    assert len(files) > 4 and max(f.stat().st_size for f in files) < sum(f.stat().st_size for f in files) / 2
    doc = document(tmp_path / "m")
    assert list(doc) == ["version", "tool", "createdAt", "network", "relayBase", "gateway", "pieces"] and doc["version"] == 1 and doc["relayBase"] is None
    assert [p["cid"] for p in doc["pieces"]] == [f"c{i:06d}" for i in range(n)] and doc["pieces"][0]["sourceUrl"] is None
    head, back = tables.read_manifest_lines(spark, f"{tmp_path}/m")
    assert head.first().gateway == "https://g.example" and back.count() == n
    got = {r.place: r.cid for r in back.where("place % 4000 = 0").collect()}
    assert got == {i: f"c{i:06d}" for i in range(0, n, 4000)}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=1))
    head, same = tables.read_manifest(spark, f"{tmp_path}/one.json")
    assert head.first().network == "calibration" and same.exceptAll(back).count() == back.exceptAll(same).count() == 0


@pytest.mark.parametrize("rows", [[], [("c", "p", 1, "u")], [("c", "p", 1, "u")] * 3, [(None, None, None, None), ("c", "p", 1, "u")]])
def test_documents_of_few_and_equal_pieces(spark, tmp_path, many_tasks, rows):
    tables.write_manifest(spark.createDataFrame(rows, "cid string, piece_cid string, raw_size long, url string"), f"{tmp_path}/m", HEAD)
    assert [p["cid"] for p in document(tmp_path / "m")["pieces"]] == [r[0] for r in rows]
    assert tables.read_manifest_lines(spark, f"{tmp_path}/m")[1].count() == len(rows)


def test_few_members_are_held_at_a_time(tmp_path):
    """A batch of 40 MB; all of its payloads were Python objects at once."""
    import tracemalloc

    import pyarrow as pa

    n, size = 2000, 20_000
    batch = pa.RecordBatch.from_pydict({"group": ["g"] * n, "bin": list(range(n)), "id": [str(i) for i in range(n)], "offset": [0] * n, "payload": pa.array([bytes(size)] * n, pa.binary())})
    objects = pa.RecordBatch.from_pydict({"id": list(range(n)), "payload": pa.array([bytes(size)] * n, pa.binary()), "top": pa.array([0] * n, pa.int32())})
    from stowage.operators import merkle

    for run in (lambda: containers.ContainerWriter(str(tmp_path)).write(iter([batch])), lambda: next(merkle._subtrees(127 << 10)(iter([objects.slice(0, 1), objects])), None)):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 10 << 20
