"""Versioned state: seven tables that change together or not at all, published by compare-and-set.

A version is a folder named by its number. It holds the parts that this version
wrote and a table of references: which parts, of this or an earlier version,
make up each table. So an append writes its own rows and nothing else. A writer
names the version it read; its folder gets the next number by a rename that
fails where that number is taken, so of two writers that read the same version
the later one is refused. The folder's file system must rename folders
atomically (HDFS and POSIX do; an object store doesn't).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables and their declared columns.
TABLES = {
    "pieces": "cid string, piece_cid string, raw_size bigint, status string, gateway string, url string, error string, failure_category string",
    "aggregates": "idx bigint, root_piece_cid string, piece_size bigint, status string, tx_hash string, error string, committed_block bigint",
    "aggregate_members": "aggregate_idx bigint, segment_index bigint, sub_piece_cid string",
    "sub_pieces": "sub_piece_cid string, raw_size bigint, status string, car_path string, url string, sha256 string",
    "sub_piece_members": "sub_piece_cid string, member_cid string, member_sort_order bigint, raw_size bigint, sha256 string",
    "pull_batch_attempts": "attempt bigint, aggregate_idx bigint, batch bigint, piece_cids array<string>, started timestamp, result string",
    "grants": "grant string, permission string, expires bigint",
}
#: What a run of rounds keeps beside them.
OWN = {"rounds": "round bigint, marked bigint, committed bigint, failed bigint, bytes bigint"}
_COLUMNS = TABLES | OWN
#: The columns that identify a row.
KEYS = {"pieces": ["cid"], "aggregates": ["idx"], "aggregate_members": ["aggregate_idx", "segment_index"], "sub_pieces": ["sub_piece_cid"], "sub_piece_members": ["sub_piece_cid", "member_cid"], "pull_batch_attempts": ["attempt"], "grants": ["grant", "permission"]}
SHOWN = 5


class StaleVersion(RuntimeError):
    """Another writer published since the version that this one read."""


class Refused(ValueError):
    """Rows break a rule of the state; nothing was published."""


class State:
    """The state in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> int:
        """The number of the last published version, 0 where there is none."""
        pattern = self._hadoop("v-*")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return max((int(f.getPath().getName()[2:]) for f in found), default=0)

    def _parts(self, version: int) -> dict[str, list[str]]:
        if not version:
            return {}
        rows = self.spark.read.schema("name string, place int, part string").parquet(f"{self.path}/v-{version:012d}/refs").orderBy("name", "place").collect()
        return {name: [r["part"] for r in rows if r["name"] == name] for name in _COLUMNS}

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the last one if none is named; without rows where nothing was ever published."""
        parts = self._parts(self.version() if version is None else version).get(name, [])
        if not parts:
            return self.spark.createDataFrame([], _COLUMNS[name])
        return self.spark.read.schema(_COLUMNS[name]).parquet(*[f"{self.path}/{p}" for p in parts])

    def publish(self, expected: int, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None) -> int:
        """Tables replaced or rows appended as the version after `expected`, which must be the last one; returns its number.

        Raises StaleVersion where another version was published since, and
        Refused where a table lacks a declared column; both leave nothing behind.
        """
        replace, append = replace or {}, append or {}
        staging = f"_staging-{uuid.uuid4().hex}"
        number = f"v-{expected + 1:012d}"
        refs = self._parts(expected)
        try:
            for name, df in [*replace.items(), *append.items()]:
                part = f"{name}-{uuid.uuid4().hex}"
                _declared(name, df).write.parquet(f"{self.path}/{staging}/{part}")
                refs[name] = [*(refs.get(name, []) if name in append else []), f"{number}/{part}"]
            rows = [(name, i, part) for name, parts in refs.items() for i, part in enumerate(parts)]
            self.spark.createDataFrame(rows, "name string, place int, part string").coalesce(1).write.parquet(f"{self.path}/{staging}/refs")
            self._rename(staging, number, expected)
        finally:
            at = self._hadoop(staging)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return expected + 1

    def _rename(self, staging: str, number: str, expected: int) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.NONE
        target = self._hadoop(number)
        if self.version() > expected:
            raise StaleVersion(f"version {expected} was read, but version {self.version()} is published")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._hadoop(staging), target, options)
        except Exception as e:
            if self.version() > expected:
                raise StaleVersion(f"version {expected} was read, but version {self.version()} is published") from e
            raise


def _declared(name: str, df: DataFrame) -> DataFrame:
    columns = [c.split(" ", 1) for c in _COLUMNS[name].split(", ")]
    missing = [c for c, _ in columns if c not in df.columns]
    if missing:
        raise Refused(f"{name} lacks {', '.join(missing)}")
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns])


def refuse(bad: DataFrame, what: str) -> None:
    """Raises Refused with the number of rows of bad (message) and the first of them."""
    n = bad.count()
    if n:
        shown = [r[0] for r in bad.orderBy("message").limit(SHOWN).collect()]
        raise Refused(f"{what}: {n} rows, nothing was published\n  " + "\n  ".join(shown))


def _message(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).alias("message")


def _new_rows(state: State, expected: int, name: str, rows: DataFrame) -> None:
    """Refuses rows with a key that comes twice or is there already."""
    keys = KEYS[name]
    label = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(_message(f"{name} ", label, " comes twice"))
    there = rows.select(*keys).distinct().join(state.table(name, expected).select(*keys), keys, "left_semi").select(_message(f"{name} ", label, " is there already"))
    refuse(twice.union(there), f"{name} with known keys")


def known(rows: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
    """(message) for each value of rows' column that no row of the table has."""
    asked = rows.select(F.col(column).alias("_k")).distinct()
    return asked.join(table.select(F.col(key).alias("_k")), "_k", "left_anti").select(_message(f"{column} ", F.col("_k"), " is unknown"))


def save_sub_pieces(state: State, expected: int, sub_pieces: DataFrame, members: DataFrame) -> int:
    """New sub-pieces with their ordered members in one version.

    Refused where a member is no piece, a sub-piece has no member or isn't
    among sub_pieces, has both or neither of container path and URL, or a key
    is taken.
    """
    pieces = state.table("pieces", expected)
    refuse(known(members, "member_cid", pieces, "cid"), "unknown members")
    refuse(known(members, "sub_piece_cid", sub_pieces, "sub_piece_cid").union(known(sub_pieces, "sub_piece_cid", members, "sub_piece_cid")), "sub-pieces and members that don't belong together")
    one = F.coalesce("car_path", F.lit("")) != ""
    refuse(sub_pieces.where(one == (F.coalesce("url", F.lit("")) != "")).select(_message("sub-piece ", F.col("sub_piece_cid"), " needs a container path or a URL, and not both")), "sub-pieces without one origin")
    _new_rows(state, expected, "sub_pieces", sub_pieces)
    _new_rows(state, expected, "sub_piece_members", members)
    return state.publish(expected, append={"sub_pieces": sub_pieces, "sub_piece_members": members})


def save_aggregates(state: State, expected: int, aggregates: DataFrame, members: DataFrame) -> int:
    """New aggregates with their ordered members in one version; refused where a member is no sub-piece, an aggregate has no member, or a key is taken."""
    refuse(known(members, "sub_piece_cid", state.table("sub_pieces", expected), "sub_piece_cid"), "unknown members")
    refuse(known(members, "aggregate_idx", aggregates, "idx").union(known(aggregates, "idx", members, "aggregate_idx")), "aggregates and members that don't belong together")
    _new_rows(state, expected, "aggregates", aggregates)
    _new_rows(state, expected, "aggregate_members", members)
    return state.publish(expected, append={"aggregates": aggregates, "aggregate_members": members})
