"""Merkle manifest: a hash tree over the rows of a table, with the proof of each row.

Rows are leaves; within a group they ascend by a key. Every ``FANOUT`` consecutive nodes become one, level by level,
until a group's subroot remains; the subroots, in the order of their groups, likewise become the root. The tree is built
by slot pivots: conditional aggregates spread the nodes below one ancestor into columns, of which each level's
concatenated runs are hashed, and a node's siblings are its run's columns without its own. One pivot takes as many levels
as ``SLOTS`` columns hold, so that the number of shuffles is a fraction of the tree's depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, saved

#: Nodes that become one, and columns of one pivot at most.
FANOUT, SLOTS = 2, 32
#: Rows of the table of (partition, group) that are broadcast at most (some 100 bytes each); larger ones are joined by shuffling.
BROADCAST_ROWS = 50_000
#: One level of a proof: the siblings left and right of the node, each joined; both empty where a node is alone.
STEP = "struct<before: string, after: string>"


def sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def field(c: Column) -> Column:
    """A value as the bytes that are hashed: its length before it, so that no two rows read alike; null: ``-``."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*columns: Column) -> Column:
    return sha(F.concat(*map(field, columns)))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` (read twice), written, with its ``rank`` from 0 by ``order`` and the number ``part`` of the range that a row
    lies in. Ranges are dealt by ``order`` as a whole, so that no value of its first columns needs to fit into a task."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id is the partition's number in its upper bits and a count of rows in the lower 33
    held = saved(ordered.withColumn("rank", F.monotonically_increasing_id()).withColumn("part", F.shiftright("rank", 33).cast("int")), "ranked")
    at, rows = 0, []
    for p, n in sorted(map(tuple, held.groupBy("part").count().collect())):  # a row a partition
        rows.append((p, at - (p << 33)))
        at += n
    shifts = F.broadcast(spark.createDataFrame(rows, "part int, shift long"))
    return held.join(shifts, "part").withColumn("rank", F.col("rank") + F.col("shift")).drop("shift")


def _steps(fanout: int) -> int:
    """Levels of one pivot."""
    k = 1
    while fanout ** (k + 1) <= SLOTS:
        k += 1
    return k


def _pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """Nodes ``g, idx, total, hash`` of one level as a row for each ancestor some levels above: its ``g, idx, total,
    hash``, and ``below``, the number of nodes of its group and the own descendants' hashes on each level between.
    ``total``: nodes of the group on a row's level."""
    k = _steps(fanout)
    width = fanout**k
    slot = F.pmod("idx", F.lit(width))
    up = F.floor(F.col("idx") / width).alias("up")
    spread = nodes.groupBy("g", up, "total").agg(*[F.max(F.when(slot == i, F.col("hash"))).alias(f"c0_{i}") for i in range(width)])
    count, below = F.col("total"), []
    for level in range(k):
        columns = [F.col(f"c{level}_{i}") for i in range(width // fanout**level)]
        below.append(F.struct(count.alias("count"), F.array_compact(F.array(*columns)).alias("hashes")))
        made = {}
        for i in range(0, len(columns), fanout):
            run = columns[i : i + fanout]
            joined = sha(F.concat(*[F.coalesce(c, F.lit("")) for c in run]))
            # the first of a run is there if any is; the last node of a group stays as it is
            made[f"c{level + 1}_{i // fanout}"] = F.when(run[0].isNotNull() & (count > 1), joined).otherwise(run[0])
        spread = spread.withColumns(made)
        count = F.ceil(count / fanout)
    return spread.select("g", F.col("up").alias("idx"), count.alias("total"), F.col(f"c{k}_0").alias("hash"), F.array(*below).alias("below"))


def _siblings(idx: Column, below: Column, fanout: int) -> Column:
    """The steps of the node ``idx`` up to its ancestor: on each level the run's columns without the own slot."""
    k = _steps(fanout)
    empty = F.array().cast(f"array<{STEP}>")
    slot, out = F.pmod(idx, F.lit(fanout**k)), []
    for level in range(k):
        own = F.floor(slot / fanout**level).cast("int")
        first, hashes = own - own % fanout, below[level]["hashes"]
        before = F.array_join(F.slice(hashes, first + 1, own - first), "")
        after = F.array_join(F.slice(hashes, own + 2, first + (fanout - 1) - own), "")
        out.append(F.when(below[level]["count"] > 1, F.array(F.struct(before.alias("before"), after.alias("after")))).otherwise(empty))
    return F.concat(*out)


def tree(leaves: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, list[DataFrame]]:
    """The roots of all groups, ``g, hash``, and the pivots that led to them, lowest first.

    ``leaves``: ``g, idx, total, hash``; idx from 0 without gaps in each group, total rows of it."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    pivots, nodes = [], leaves
    while most > 1:
        pivots.append(saved(_pivot(nodes, fanout), "pivot"))
        nodes = pivots[-1].select("g", "idx", "total", "hash")
        most = -(-most // fanout ** _steps(fanout))
    return nodes.select("g", "hash"), pivots


def _below(nodes: DataFrame, parents: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with the columns of ``parents`` (``g, idx, below, path`` and others) and their own paths. Parents are
    unique and have a few nodes each, so that no key is hot."""
    width = fanout ** _steps(fanout)
    up = parents.withColumnsRenamed({"g": "g_up", "idx": "idx_up", "path": "path_up"})
    met = nodes.join(up, (F.col("g") == F.col("g_up")) & (F.floor(F.col("idx") / width) == F.col("idx_up")))
    return met.withColumn("path", F.concat(_siblings(F.col("idx"), F.col("below_up"), fanout), "path_up")).drop("g_up", "idx_up", "below_up", "path_up")


def descend(roots: DataFrame, pivots: list[DataFrame], leaves: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` (``g, idx`` and others) with their paths and the other columns of ``roots``, whose ``path`` leads on from
    the root of group ``g``."""
    if not pivots:
        return leaves.join(roots, "g")
    above = roots.withColumn("idx", F.lit(0).cast("long"))
    for n in reversed(range(len(pivots))):
        keyed = pivots[n].select(F.col("g").alias("g_own"), F.col("idx").alias("idx_own"), F.col("below").alias("below_up"))
        parents = keyed.join(above, (F.col("g_own") == F.col("g")) & (F.col("idx_own") == F.col("idx"))).drop("g_own", "idx_own")
        above = _below(pivots[n - 1].select("g", "idx") if n else leaves, parents, fanout)
    return above


def manifest(rows: DataFrame, group: str, key: str, leaf: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """``rows`` with ``path, subroot, root`` added.

    Leaves (column ``leaf``: hex hashes) of each value of ``group`` ascend by ``key``, null first, rows of one key by
    their leaf; groups are ordered by their bytes, null first. Repeated rows are leaves of their own, with whatever
    of their places. ``path``: the siblings before and after the node on each level up to the root. Other columns are
    carried along whatever their names, but for columns of the three names above, which are replaced. An empty table
    gives none and has no root.
    """
    # other columns in one, so that none can clash; texts are hashed once
    leaves = saved(
        rows.select(F.struct(*columns_of(rows, ("path", "subroot", "root"))).alias("row"), F.col(group).alias("grp"), F.col(key).alias("key"), F.col(leaf).alias("hash")),
        "leaves",
    )
    held = ranked(leaves, ["grp", "key", "hash"])
    # ranges of a group follow each other: its first rank and its rows come from one row a range and group
    spans = saved(held.groupBy("part", "grp").agg(F.min("rank").alias("low"), F.count("*").alias("n")), "spans")
    groups = saved(spans.groupBy("grp").agg(F.min("low").alias("first"), F.sum("n").alias("total")), "groups")
    groups = ranked(groups, ["grp"]).select(F.col("rank").alias("g"), F.col("grp").alias("grp_of"), "first", "total")
    placed = spans.join(groups, F.col("grp").eqNullSafe(F.col("grp_of"))).select(F.col("part").alias("part_of"), "grp_of", "g", "first", "total")
    if spans.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    nodes = held.join(placed, (F.col("part") == F.col("part_of")) & F.col("grp").eqNullSafe(F.col("grp_of")))
    nodes = nodes.select("row", "hash", "g", (F.col("rank") - F.col("first")).alias("idx"), "total")
    # the lower tree, and the tree of its roots
    roots, pivots = tree(nodes.select("g", "idx", "total", "hash"), fanout)
    roots = saved(roots, "subroots")
    tops = roots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("idx"), F.lit(roots.count()).cast("long").alias("total"), "hash")
    root, above = tree(tops, fanout)
    top = root.select("g", F.col("hash").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    subroots = descend(top, above, tops.select("g", "idx", F.col("hash").alias("subroot")), fanout)
    subroots = saved(subroots.select(F.col("idx").alias("g"), "subroot", "root", "path"), "subroots")
    found = descend(subroots, pivots, nodes.select("row", "g", "idx"), fanout)
    return found.select("row.*", "path", "subroot", "root")


def proof_hash(path: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return sha(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, s: sha(F.concat(s["before"], h, s["after"])))
