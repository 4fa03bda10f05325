"""Container files: a Python data source that writes members in order, one file a bin, with an index of their offsets.

A task writes under names of its own in a temporary folder; only when all
tasks have ended are the files of the attempts that count moved to their names,
the containers first and then the index that names them. Attempts that failed or came
second leave nothing, and neither does a job that is given up. Paths are those
of pyarrow's file systems (local or mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..plans.primitives import few_rows

SCHEMA = "group string, bin bigint, id string, offset bigint, payload binary"
INDEX = pa.schema([("group", pa.string()), ("bin", pa.int64()), ("container", pa.string()), ("id", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("sha256", pa.string())])
#: Index rows that a task holds before it writes them.
HELD = 50_000


@dataclass
class Written(WriterCommitMessage):
    """(name, temporary path) of a task's containers, and its part of the index."""

    containers: list[tuple[str, str]] = field(default_factory=list)
    index: str | None = None


class ContainerWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = self._open()
        mine = f"{root}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(mine, recursive=True)
        done, rows, out, key, at, index = Written(), [], None, None, 0, None
        try:
            for batch in few_rows(iterator):
                for group, number, member, offset, payload in zip(*(batch.column(c).to_pylist() for c in ("group", "bin", "id", "offset", "payload"))):
                    if (group, number) != key:
                        if out is not None:
                            out.close()
                        key, at, name = (group, number), 0, f"{group}-{number}.bin"
                        temporary = f"{mine}/{len(done.containers)}"
                        out = store.open_output_stream(temporary)
                        done.containers.append((name, temporary))
                    if offset != at:
                        raise ValueError(f"{name}: member {member} is planned at {offset}, the container has {at} bytes")
                    out.write(payload)
                    rows.append((group, number, name, member, at, len(payload), hashlib.sha256(payload).hexdigest()))
                    at += len(payload)
                if len(rows) >= HELD:
                    index = self._flush(store, mine, index, rows)
            if out is not None:
                out.close()
                index = self._flush(store, mine, index, rows)
                index.close()
                done.index = f"{mine}/index"
        except BaseException:
            store.delete_dir(mine)
            raise
        return done

    def _flush(self, store: fs.FileSystem, mine: str, index, rows: list[tuple]):
        index = index or pq.ParquetWriter(f"{mine}/index", INDEX, filesystem=store)
        index.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX)] if rows else [pa.array([], f.type) for f in INDEX], schema=INDEX))
        rows.clear()
        return index

    def commit(self, messages: list) -> None:
        store, root = self._open()
        found = [m for m in messages if m is not None]
        store.create_dir(f"{root}/index", recursive=True)
        for name, temporary in (c for m in found for c in m.containers):
            store.move(temporary, f"{root}/{name}")
        for m in found:
            if m.index:
                store.move(m.index, f"{root}/index/{uuid.uuid4().hex}.parquet")
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*self._open())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")


class ContainerSource(DataSource):
    """spark.dataSource.register(ContainerSource); df.write.format("containers").save(path)."""

    @classmethod
    def name(cls) -> str:
        return "containers"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ContainerWriter:
        if overwrite:
            raise ValueError("containers are only ever added")
        return ContainerWriter(self.options["path"])


def write_containers(plan: DataFrame, payloads: DataFrame, path: str) -> DataFrame:
    """One container for each bin of plan (group, bin, id, offset), with payloads (id, payload) at the planned offsets; returns the index (group, bin, container, id, offset, size, sha256).

    A bin is bounded by its cap, so a group with most of the rows is many tasks.
    """
    spark = plan.sparkSession
    spark.dataSource.register(ContainerSource)
    rows = plan.select("id", F.col("group").cast("string").alias("group"), "bin", "offset").join(payloads.select("id", "payload"), "id")
    rows = rows.repartition("group", "bin").sortWithinPartitions("group", "bin", "offset", "id")
    rows.select("group", "bin", F.col("id").cast("string").alias("id"), "offset", F.coalesce("payload", F.lit(b"")).alias("payload")).write.format("containers").mode("append").save(path)
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("group string, bin bigint, container string, id string, offset bigint, size bigint, sha256 string").parquet(f"{path}/index")


def _members(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        name = file = None
        try:
            for batch in few_rows(batches):
                payloads = []
                for container, offset, size in zip(*(batch.column(c).to_pylist() for c in ("container", "offset", "size"))):
                    if container != name:
                        if file is not None:
                            file.close()
                        name, file = container, store.open_input_file(f"{root}/{container}")
                    payloads.append(file.read_at(size, offset))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary())], [*batch.schema.names, "payload"])
        finally:
            if file is not None:
                file.close()

    return run


def read_members(index: DataFrame, path: str) -> DataFrame:
    """index rows with payload, each read at its offset; a container is opened once by the task that reads from it."""
    rows = index.repartition("container").sortWithinPartitions("container", "offset")
    return rows.mapInArrow(_members(path), ", ".join(f"`{n}` {t}" for n, t in index.dtypes) + ", payload binary")
