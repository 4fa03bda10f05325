"""Depth-first order of block graphs: shallow ones by least paths, a level at a time; else trees by sizes from below and ranks from above (chains by list ranking), and least paths between the nodes that several parents share."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .primitives import cut, places_within, shared_dir, sums_within

#: Links below the roots up to which graphs are walked a level at a time. The number decides the way, not the result.
SHALLOW = 8


def list_ranks(arcs: DataFrame) -> DataFrame:
    """(arc, last, n, level): from rows (arc, next, n, level) of lists, the last arc of each one's list and the sums of n and level from it to the end.

    Every round doubles how far an arc sees, so rounds grow with the logarithm
    of the longest list.
    """
    seen = cut(arcs.select("arc", "next", F.col("arc").alias("last"), F.col("n").cast("long").alias("n"), F.col("level").cast("long").alias("level")))
    while not seen.where("next IS NOT NULL").isEmpty():
        ahead = seen.select(F.col("arc").alias("_arc"), F.col("next").alias("_next"), F.col("last").alias("_last"), F.col("n").alias("_n"), F.col("level").alias("_level"))
        j = seen.join(ahead, F.col("next") == F.col("_arc"), "left")
        more = lambda c: (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c)
        seen = cut(j.select("arc", F.col("_next").alias("next"), F.coalesce("_last", "last").alias("last"), more("n"), more("level")))
    return seen.drop("next")


def _items(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(item, node, parent item, link_index, leaf): each head, each child that isn't one, and a leaf for each link to a head."""
    top = heads.select("node", F.lit(None).cast(dict(edges.dtypes)["parent"]).alias("parent"), F.lit(None).cast("long").alias("link_index"), F.lit(False).alias("leaf"))
    is_head = heads.select(F.col("node").alias("child"), F.lit(True).alias("leaf"))
    below = edges.join(is_head, "child", "left").select(F.col("child").alias("node"), "parent", "link_index", F.coalesce("leaf", F.lit(False)).alias("leaf"))
    items = cut(top.union(below).withColumn("item", F.monotonically_increasing_id()))
    owners = items.where("NOT leaf").select(F.col("node").alias("parent"), F.col("item").alias("above"))
    under = items.where("parent IS NOT NULL").join(owners, "parent").select("item", "node", "above", "link_index", "leaf")
    return cut(items.where("parent IS NULL").select("item", "node", F.lit(None).cast("long").alias("above"), "link_index", "leaf").union(under))


def _core_sizes(core: DataFrame) -> DataFrame:
    """(item, whole): what all items below each one weigh, from core (item, above, link_index, size), where size is the item's own weight.

    The tour goes down to an item's first child, else up again, and from there
    to the next sibling, else up to the parent; down(i) is arc 2i, up(i) 2i + 1.
    """
    placed = cut(places_within(core.where("above IS NOT NULL"), ["above"], ["link_index", "item"]).select("item", "above", "place"))
    first = placed.where("place = 0").select(F.col("above").alias("item"), F.col("item").alias("child"))
    later = placed.select("above", (F.col("place") - 1).alias("place"), F.col("item").alias("sibling"))
    down = core.select("item", "size").join(first, "item", "left").select((F.col("item") * 2).alias("arc"), F.coalesce(F.col("child") * 2, F.col("item") * 2 + 1).alias("next"), F.col("size").alias("n"), F.lit(0).alias("level"))
    up = placed.join(later, ["above", "place"], "left").select((F.col("item") * 2 + 1).alias("arc"), F.coalesce(F.col("sibling") * 2, F.col("above") * 2 + 1).alias("next"), F.lit(0).alias("n"), F.lit(0).alias("level"))
    last = core.where("above IS NULL").select((F.col("item") * 2 + 1).alias("arc"), F.lit(None).cast("long").alias("next"), F.lit(0).alias("n"), F.lit(0).alias("level"))
    n = F.col("n")
    return list_ranks(down.union(up).union(last)).groupBy(F.expr("arc div 2").alias("item")).agg((F.max(n) - F.min(n)).alias("whole"))


def preorder(items: DataFrame) -> DataFrame:
    """items with top (the item of their tree's head), rank (0-based place in the tree's depth-first order) and level (links below the head).

    Items without children are taken off as long as these are a quarter of what
    is left, so all rounds together handle a few times the items; what is left
    then (chains) is measured by list ranking. An item's step is one more than
    what its earlier siblings weigh; ranks are sums of steps on the way down,
    where items follow in the reverse order of the rounds.
    """
    kids = items.where("above IS NOT NULL").groupBy(F.col("above").alias("item")).agg(F.count("*").alias("kids"))
    own = items.where("NOT leaf").join(kids, "item", "left").select(*items.columns, F.coalesce("kids", F.lit(0)).alias("kids"), F.lit(1).cast("long").alias("size"))
    bare = items.where("leaf").select("*", F.lit(0).cast("long").alias("kids"), F.lit(1).cast("long").alias("size"))
    left, taken, core = cut(own), [], None
    while True:
        total, ready = left.agg(F.count("*"), F.count_if(F.col("kids") == 0)).first()
        off = left.where("kids = 0")
        if not taken:
            off = bare.union(off)
        taken.append(off)
        rest = left.where("kids > 0")
        if ready == total:
            break
        found = off.where("above IS NOT NULL").groupBy(F.col("above").alias("item")).agg(F.count("*").alias("_n"), F.sum("size").alias("_s"))
        left = cut(rest.join(found, "item", "left").select(*items.columns, (F.col("kids") - F.coalesce("_n", F.lit(0))).alias("kids"), (F.col("size") + F.coalesce("_s", F.lit(0))).alias("size")))
        if ready * 4 < total:
            core = left.drop("size").join(_core_sizes(left), "item").withColumnRenamed("whole", "size")
            break
    rounds = [*taken, core] if core is not None else taken
    every = rounds[0].select(*items.columns, "size", F.lit(0).alias("round"))
    for k, t in enumerate(rounds[1:], 1):
        every = every.union(t.select(*items.columns, "size", F.lit(k).alias("round")))
    stepped = sums_within(every.where("above IS NOT NULL"), ["above"], ["link_index", "item"], F.col("size"), "earlier").withColumn("step", F.col("earlier") + 1).drop("earlier", "size")
    steps = cut(stepped.unionByName(every.where("above IS NULL").drop("size").withColumn("step", F.lit(0).cast("long"))))
    zero = F.lit(0).cast("long")
    known = []
    for k in reversed(range(len(rounds))):
        here = steps.where(F.col("round") == k).drop("round")
        if core is not None and k == len(rounds) - 1:
            ranks = list_ranks(here.select(F.col("item").alias("arc"), F.col("above").alias("next"), F.col("step").alias("n"), F.col("above").isNotNull().cast("long").alias("level")))
            known.append(cut(here.join(ranks.select(F.col("arc").alias("item"), F.col("last").alias("top"), F.col("n").alias("rank"), "level"), "item").select(*items.columns, "top", "rank", "level")))
            continue
        out = here.where("above IS NULL").select(*items.columns, F.col("item").alias("top"), zero.alias("rank"), zero.alias("level"))
        if known:
            over = reduce(DataFrame.union, known).select(F.col("item").alias("above"), "top", F.col("rank").alias("_rank"), F.col("level").alias("_level"))
            below = here.where("above IS NOT NULL").join(over, "above").select(*items.columns, "top", (F.col("_rank") + F.col("step")).alias("rank"), (F.col("_level") + 1).alias("level"))
            out = out.union(below)
        known.append(cut(out))
    return reduce(DataFrame.union, known)


def _between_heads(links: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(root, top, path, depth): to each head that a root reaches, the least array of ranks over links (top, rank, level, to), and how many links lie on it."""
    best = cut(roots.select("root", "top", F.array().cast("array<bigint>").alias("path"), F.lit(0).cast("long").alias("depth")))
    front = best
    for _ in range(most + 1):
        step = front.join(links, "top").select("root", F.col("to").alias("top"), F.struct(F.array_append("path", F.col("rank")).alias("path"), (F.col("depth") + F.col("level")).alias("depth")).alias("p"))
        step = step.groupBy("root", "top").agg(F.min("p").alias("p"))
        old = best.select("root", "top", F.col("path").alias("old"))
        front = cut(step.join(old, ["root", "top"], "left").where("old IS NULL OR p.path < old").select("root", "top", "p.path", "p.depth"))
        if front.isEmpty():
            return best
        best = cut(best.unionByName(front).groupBy("root", "top").agg(F.min(F.struct("path", "depth")).alias("p")).select("root", "top", "p.path", "p.depth"))
    raise ValueError("the links go round in a circle")


def by_parent(links: DataFrame) -> DataFrame:
    """links written to the shared folder in buckets of their parent, so that joins on it don't shuffle them."""
    spark = links.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"links_{uuid.uuid4().hex}"
    links.repartition(n, "parent").write.bucketBy(n, "parent").sortBy("parent").option("compression", "zstd").option("path", f"{shared_dir(spark)}/table-{name}").saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay
    return kept


def _step(index: Column) -> Column:
    """A link's part of a path: one letter that tells the number of hex digits, and these, so that paths as strings sort like lists of numbers."""
    digits = F.hex(index)
    letter = F.substring(F.lit("abcdefghijklmnop"), F.length(digits), F.lit(1))
    return F.coalesce(F.concat(F.when(index < 0, "Z").otherwise(letter), digits), F.lit("Y"))


def _levels(links: DataFrame, roots: DataFrame, paths: bool) -> list[DataFrame] | None:
    """(root, node) that each number of links reaches, with the least path of that number where paths; None where they go on below SHALLOW."""
    front = cut(roots.select("root", "node", *([F.lit("").alias("path")] if paths else [])).distinct())
    levels = [front]
    while not front.isEmpty():
        if len(levels) > SHALLOW + 1:
            return None
        found = front.join(links, front["node"] == links["parent"])
        if paths:
            each = found.select("root", F.col("child").alias("node"), F.concat("path", _step(F.col("link_index"))).alias("path"))
            front = cut(each.groupBy("root", "node").agg(F.min("path").alias("path")))
        else:
            front = cut(found.select("root", F.col("child").alias("node")).distinct())
        levels.append(front)
    return levels


def reached(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) of every node that a root reaches, from links by_parent and roots as first_visits has them."""
    levels = _levels(links, roots, False)
    return _first_visits_deep(links, roots).select("root", "node") if levels is None else reduce(DataFrame.union, levels).distinct()


def first_visits(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, path, depth) of every node that a root reaches, from links (parent, link_index, child) by_parent, without circles, and roots (root, node).

    path sorts like the depth-first order in which first visits count, and depth
    is the number of links of that first visit. As long as all nodes lie within
    SHALLOW links, each level is one join of the level above with its links, and
    a path is a short string: links are shuffled once, with their paths.
    """
    levels = _levels(links, roots, True)
    if levels is None:
        return _first_visits_deep(links, roots)
    best = reduce(DataFrame.union, levels).groupBy("root", "node").agg(F.min("path").alias("path"))
    return best.select("root", "node", "path", F.length(F.translate("path", "0123456789ABCDEF", "")).cast("long").alias("depth"))


def depth_first(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, place, depth) of every node that a root reaches, from links (parent, link_index, child) without circles and roots (root, node).

    place is the node's in the depth-first order in which first visits count,
    depth as in first_visits. No task orders all nodes of a root.
    """
    return ordered(by_parent(links), roots)


def ordered(links: DataFrame, roots: DataFrame) -> DataFrame:
    """As depth_first, from links by_parent."""
    return places_within(first_visits(links, roots), ["root"], ["path"]).select("root", "node", "place", "depth")


def _first_visits_deep(links: DataFrame, roots: DataFrame) -> DataFrame:
    """As first_visits, however deep the graph is.

    Heads are the roots' nodes and those that several parents or none link to; all
    other nodes hang below one head in a tree, which preorder orders however
    deep it is. What is left are the links between heads: as many rounds
    as heads follow one another on a path.
    """
    edges = cut(links.groupBy("parent", "child").agg(F.min("link_index").cast("long").alias("link_index")))
    shared = edges.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").select(F.col("child").alias("node"))
    unlinked = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    heads = cut(shared.union(roots.select("node")).union(unlinked).distinct())
    order = preorder(_items(edges, heads))
    at = order.where("item = top").select("node", F.col("top").alias("to"))
    between = cut(order.where("leaf").join(at, "node").select("top", "rank", "level", "to"))
    begun = roots.join(at.withColumnRenamed("to", "top"), "node").select("root", "top").distinct()
    met = _between_heads(between, begun, heads.count())
    inside = order.where("NOT leaf").select("top", "node", "rank", "level")
    return met.join(inside, "top").select("root", "node", F.array_append("path", F.col("rank")).alias("path"), (F.col("depth") + F.col("level")).alias("depth"))
