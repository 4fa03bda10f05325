"""What the operators share: where intermediate tables go, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\f\r"

_local: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-stowage-"))
    return _local[0]


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The result has no lineage behind it, survives lost executors, and is
    computed once however often it is used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stowage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if "/stowage-" in str(path.toString()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_keys(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """docs with _row_key: the doc_id, or a number of its own above every doc_id for a row without one; and the greatest doc_id, None where no row lacks one."""
    none = docs.where("doc_id IS NULL")
    if none.isEmpty():
        return docs.withColumn("_row_key", F.col("doc_id")), None
    most = docs.agg(F.max("doc_id")).first()[0]
    most = -1 if most is None else most
    own = cut(none.withColumn("_row_key", F.monotonically_increasing_id() + F.lit(most + 1)))
    return docs.where("doc_id IS NOT NULL").withColumn("_row_key", F.col("doc_id")).unionByName(own), most


def hash_sample(df: DataFrame, key: str, most: int, total: int, salt: str) -> DataFrame:
    """About `most` of the `total` rows of df, by a 64-bit hash of key: all where there are no more, and as many of however large a table."""
    if most >= total:
        return df
    bound = min((1 << 64) - 1, (most << 64) // total) - (1 << 63)
    return df.where(F.xxhash64(key, F.lit(salt)) <= bound)


def let(name: str, value: str, body: str) -> str:
    """SQL for body in which name stands for value, made once: a column that a lambda names may be computed again for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running_sums(array: str, block: int = 64) -> str:
    """SQL for the running sums of an array of bigint.

    Appending to an array copies it, so sums are made within blocks and then
    over the blocks' totals: n * block + (n / block)^2 copies instead of n^2.
    """
    last = lambda a: f"coalesce(element_at({a}, -1), 0L)"
    grow = lambda a, x: f"array_append({a}, coalesce(try_element_at({a}, -1), 0L) + {x})"
    none = "cast(array() as array<bigint>)"
    blocks = f"transform(sequence(0, cast(greatest(ceil(size(z) / {block}) - 1, 0) as int)), b -> aggregate(slice(z, b * {block} + 1, {block}), {none}, (acc, x) -> {grow('acc', 'x')}))"
    tops = f"aggregate(bl, array(0L), (acc, b) -> {grow('acc', 'coalesce(try_element_at(b, -1), 0L)')})"
    moved = "flatten(transform(bl, (b, i) -> transform(b, x -> x + top[i])))"
    return let("z", array, let("bl", blocks, let("top", tops, moved)))


def words_of(text: Column) -> Column:
    """The array of words `[^\\x20\\x09-\\x0D]+`; none for null or blank text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component): the least id that each node of edges (a, b) reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each one
    aggregate and one join on the edge table; no node's neighbours are ever
    gathered into a row. Nodes without an edge don't appear; empty edges give
    an empty result.
    """

    def mins(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = mins(both).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        own = mins(e)  # every edge points from the larger id to the smaller
        return e.join(own, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("u", F.col("m").alias("v")))

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        new = cut(small(large(e).distinct()).distinct())
        drop(e)
        e = new
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

