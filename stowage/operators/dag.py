"""Block graphs: verification, order, completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..plans.graphs import by_parent, first_visits, ordered, reached
from ..registry import query
from .joins import verify_blocks


@query("dg1_verify_blocks", "SELECT node, sha256(bytes) = digest AS valid FROM blocks")
def dg1(spark, d):
    return verify_blocks(fx.blocks(spark, d)).select("node", "valid")


def dedupe_blocks(df: DataFrame) -> DataFrame:
    """The first position of each (root, node); made per task before the shuffle."""
    return df.groupBy("root", "node").agg(F.min("pos").alias("pos"))


@query("dg2_dedupe_blocks", "SELECT parent[1] AS root, child AS node, min(link_index) AS pos FROM links GROUP BY 1, 2")
def dg2(spark, d):
    return dedupe_blocks(fx.links(spark, d).select(F.substring("parent", 1, 1).alias("root"), F.col("child").alias("node"), F.col("link_index").alias("pos")))


_PATHS = """RECURSIVE w AS (SELECT DISTINCT parent AS root, parent AS node, []::BIGINT[] AS path FROM links WHERE parent NOT IN (SELECT child FROM links) UNION ALL SELECT root, child, list_append(path, link_index) FROM w JOIN links ON parent = node),
    p AS (SELECT root, node, min(path) AS path FROM w GROUP BY 1, 2)"""


def _graph(spark, d):
    """links by parent, and roots: each parent that is no child."""
    links = by_parent(fx.links(spark, d))
    roots = links.select("parent").distinct().join(links.select(F.col("child").alias("parent")).distinct(), "parent", "left_anti")
    return links, roots.select(F.col("parent").alias("root"), F.col("parent").alias("node"))


@query("dg3_dag_order", f"{_PATHS} SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS place FROM p")
def dg3(spark, d):
    links, roots = _graph(spark, d)
    return ordered(links, roots).select("root", "node", "place")


def missing_blocks(order: DataFrame, blocks: DataFrame) -> DataFrame:
    return order.join(blocks.select("node").distinct(), "node", "left_anti").groupBy("root").agg(F.count("*").alias("missing"))


@query("dg4_missing_blocks", f"{_PATHS} SELECT root, count(*) AS missing FROM p WHERE node NOT IN (SELECT node FROM blocks) AND node <> root GROUP BY root")
def dg4(spark, d):
    links, roots = _graph(spark, d)
    return missing_blocks(reached(links, roots).where("node <> root"), fx.blocks(spark, d, links))


def dag_stats(order: DataFrame, blocks: DataFrame) -> DataFrame:
    b = blocks.select("node", F.octet_length("bytes").alias("size"))
    return order.join(b, "node", "left").groupBy("root").agg(F.count("*").alias("nodes"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max("depth").cast("int").alias("depth"))


@query("dg5_dag_stats", f"{_PATHS} SELECT root, count(*) AS nodes, coalesce(sum(strlen(bytes)), 0) AS bytes, max(len(path)) AS depth FROM p LEFT JOIN blocks USING (node) GROUP BY root")
def dg5(spark, d):
    links, roots = _graph(spark, d)
    return dag_stats(first_visits(links, roots), fx.blocks(spark, d, links))


def check_declared(df: DataFrame) -> DataFrame:
    """df (id, roots): the failure category of a stream that doesn't declare the requested id."""
    return df.withColumn("category", F.when(~F.coalesce(F.array_contains("roots", F.col("id")), F.lit(False)), "car_root_mismatch"))


@query("dg6_declared_roots", "SELECT parent AS id, CASE WHEN NOT list_contains(list(child), 'p' || parent[2:]) THEN 'car_root_mismatch' END AS category FROM links GROUP BY parent")
def dg6(spark, d):
    g = fx.links(spark, d).groupBy("parent").agg(F.collect_list("child").alias("roots"))
    return check_declared(g.select(F.col("parent").alias("p"), F.concat(F.lit("p"), F.substring("parent", 2, 20)).alias("id"), "roots")).select(F.col("p").alias("id"), "category")
