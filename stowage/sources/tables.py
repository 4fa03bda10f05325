"""Text inventories, manifests and binary objects."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.primitives import cut, global_prefix, shared_dir

#: Names and order of the fields of a manifest.
HEADER = ("version", "tool", "createdAt", "network", "relayBase", "gateway")
PIECE = "cid string, pieceCid string, rawSize bigint, sourceUrl string"
_HEADER = "version int, tool string, createdAt string, network string, relayBase string, gateway string"
MANIFEST = f"{_HEADER}, pieces array<struct<{PIECE}>>"


def write_lines(lines: DataFrame) -> str:
    """lines (line_no, line) as ordered text files; returns the folder."""
    path = f"{shared_dir(lines.sparkSession)}/lines-{uuid.uuid4().hex}"
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.text(path)
    return path


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx, line) of the lines of text files in order of name; files are split where Spark splits them."""
    t = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return global_prefix(cut(t), ["file", "block", "at"]).select("idx", "line")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, id): trimmed lines that aren't blank or comments, with their 1-based number over the files in order of name."""
    numbered = _numbered_lines(spark, path)
    trimmed = numbered.select((F.col("idx") + 1).alias("line_no"), F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("id"))
    return trimmed.where((F.col("id") != "") & ~F.col("id").startswith("#"))


def _piece(p: Column) -> list[Column]:
    return [p["cid"].alias("cid"), p["pieceCid"].alias("piece_cid"), p["rawSize"].alias("raw_size"), p["sourceUrl"].alias("url")]


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, pieces (place, cid, piece_cid, raw_size, url)) of one manifest document in one file, as any tool writes it; fields of another type are null."""
    t = spark.read.schema(MANIFEST).json(path, multiLine=True)
    pieces = t.select(F.posexplode("pieces").alias("place", "p"))
    return t.select(*HEADER), pieces.select(F.col("place").cast("long").alias("place"), *_piece(F.col("p")))


def write_manifest(pieces: DataFrame, path: str, header: dict[str, str]) -> None:
    """One JSON document of header and pieces (cid, piece_cid, raw_size, url) in order of cid, as the text files of a folder.

    The files one after another, in order of name, are the document: the first
    begins with the header, each piece is a line, all lines of pieces but the
    first begin with the comma before them, and the last file ends it. So tasks
    write their ranges side by side, and no task or row holds all pieces.
    """
    spark = pieces.sparkSession
    keys = ["cid", "piece_cid", "raw_size", "url"]
    said = F.to_json(F.struct("cid", F.col("piece_cid").alias("pieceCid"), F.col("raw_size").alias("rawSize"), F.col("url").alias("sourceUrl")), {"ignoreNullFields": "false"})
    rows = pieces.groupBy(*keys).agg(F.count("*").alias("n"))  # equal rows stay, but only one of them may be the first
    least = rows.agg(F.min(F.struct(*keys)).alias("least"))
    each = rows.join(F.broadcast(least)).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    first = (F.col("i") == 1) & F.struct(*keys).eqNullSafe(F.col("least"))
    lines = each.select(F.lit(1).alias("part"), *keys, F.concat(F.when(first, "").otherwise(","), said).alias("line"))
    values = {"version": F.lit(1)} | {k: F.lit(header.get(k)).cast("string") for k in HEADER[1:]}
    head = F.to_json(F.struct(*[values[k].alias(k) for k in HEADER]), {"ignoreNullFields": "false"})
    kinds = dict(lines.dtypes)
    edges = spark.createDataFrame([(0,), (2,)], "part int").select("part", *[F.lit(None).cast(kinds[k]).alias(k) for k in keys])
    edges = edges.withColumn("line", F.when(F.col("part") == 0, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"pieces":['))).otherwise("]}"))
    order = ["part", *keys]
    lines.union(edges).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def read_manifest_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As read_manifest, of the files of write_manifest: a line a piece, in as many tasks as there are splits."""
    lines = cut(_numbered_lines(spark, path))
    head = lines.where("idx = 0").select(F.from_json(F.concat("line", F.lit("]}")), _HEADER).alias("h")).select("h.*")
    body = lines.where("idx > 0 AND line <> ']}'").select((F.col("idx") - 1).alias("place"), F.from_json(F.regexp_replace("line", "^,", ""), PIECE).alias("p"))
    return head, body.select("place", *_piece(F.col("p")))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload, raw_size, digest_hex) of binary files."""
    t = spark.read.format("binaryFile").load(path)
    return t.select("path", F.col("content").alias("payload"), F.octet_length("content").cast("long").alias("raw_size"), F.sha2("content", 256).alias("digest_hex"))
