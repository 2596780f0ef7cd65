"""Near-duplicates by SimHash.

Fingerprints are compared through a segment-popcount embedding. A fingerprint is mapped to the
number of set bits of each of its 32 two-bit segments. The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints, so pairs within ``distance`` bits lie within
``distance`` of each other in that lattice: a range join. The lattice is cut into blocks of
segments. Two vectors within distance d agree in all but d of the blocks, so a grid whose cells are
the sub-vectors of ``blocks - d`` blocks, one grid for each choice of blocks, puts every such pair
into a common cell. Pairs of a cell are held against the Manhattan distance of their whole vectors
first (three operations on the packed counts), and what is left against the exact Hamming distance.

A cell of very many fingerprints is that of a large group of near copies, of which all pairs would be
made. Its fingerprints that differ in one bit are linked first, each with the smallest that shares all
other bits, and what then belongs to the cell's largest group is compared with the other members of
the cell alone. That loses no link between different groups, and no component changes by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, columns_of, join_hot_apart, saved, unused

#: Bits by which linked fingerprints may differ, words of a shingle, seed of the hash.
DISTANCE, SHINGLE, SEED = 4, 4, 42
#: Blocks of the 32 segments. ``BLOCKS`` over ``DISTANCE`` give 70 grids of 16 dimensions.
BLOCKS, SEGMENTS = 8, 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over the XXH64 of every shingle of white-space words, repeats included, A-Z
    lower-cased. Fewer words than a shingle: the whole sequence; none (null too): 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    count, n = np.zeros(64, np.int64), len(hashes)
    array = np.array(hashes, np.uint64)
    for at in range(0, n, 65536):  # bounds the memory of a very long text
        part = array[at : at + 65536].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``id, text_hash, fingerprint`` for each row: doc_id with NO_ID for null, XXH64 of the text, and the
    64 bits as a signed long. Texts are not shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = np.array([fingerprint(t) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"id": b["id"], "text_hash": b["text_hash"], "fingerprint": bits.view(np.int64)})

    ready = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    return ready.mapInPandas(run, "id long, text_hash long, fingerprint long")


#: Fingerprints that are broadcast at most: those of 1 / HOT_KEYS of all rows or more.
HOT_KEYS = 1000
#: Fingerprints of a cell from which its near copies are grouped before pairs are made.
HOT_CELL = 2048
_ONES, _TWOS = 0x1111111111111111, 0x2222222222222222


def popcounts(fp: Column) -> tuple[Column, Column]:
    """The embedding: the bit counts (0 to 2) of the 32 two-bit segments, each in four bits of two longs (even
    and odd segments)."""
    bit = lambda n: (F.shiftrightunsigned(fp, n) if n else fp).bitwiseAND(F.lit(_ONES))
    return bit(0) + bit(1), bit(2) + bit(3)


def manhattan(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The Manhattan distance of two embeddings, by counting bits of all segments at once: with 2 added to each
    count a difference d is 2 + d (0 to 4) in its four bits, and with bit 1 turned over |d| = 1 has bit 0
    set, |d| = 2 bit 1 without bit 0."""
    total = F.lit(0)
    for x, y in zip(a, b):
        turned = (x + F.lit(_TWOS) - y).bitwiseXOR(F.lit(_TWOS))
        one = turned.bitwiseAND(F.lit(_ONES))
        two = F.shiftrightunsigned(turned, 1).bitwiseAND(one.bitwiseXOR(F.lit(_ONES)))
        total = total + F.bit_count(one) + 2 * F.bit_count(two.bitwiseAND(F.lit(_ONES)))
    return total


def _block_of(even: Column, odd: Column, block: int, blocks: int) -> Column:
    """The counts of a block's segments side by side."""
    bits = 4 * SEGMENTS // blocks // 2
    mask = F.lit((1 << bits) - 1)
    part = lambda c: F.shiftrightunsigned(c, bits * block).bitwiseAND(mask)
    return F.shiftleft(part(odd), 2).bitwiseOR(part(even))


def _grids(distance: int, blocks: int) -> list[tuple[int, ...]]:
    if not 0 < distance < blocks <= SEGMENTS // 2 or SEGMENTS % (2 * blocks):
        raise ValueError("blocks must divide 16 and exceed the distance")
    if 2 * SEGMENTS // blocks * (blocks - distance) > 48:
        raise ValueError("a cell and the number of its grid must fit 63 bits")
    return list(combinations(range(blocks), blocks - distance))


def _points(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``fingerprint, cell`` for each grid."""
    per = 2 * SEGMENTS // blocks

    def cell(n: int, chosen: tuple[int, ...]) -> Column:
        # the grid's number and the chosen blocks' counts side by side: an exact key of one long
        key = F.lit(n << per * len(chosen)).cast("long")
        for j, i in enumerate(chosen):
            key = key.bitwiseOR(F.shiftleft(F.col(f"part{i}"), per * j))
        return key

    # the counts are columns of their own, so that the plan holds each expression once
    embedded = prints.select("fingerprint", *[c.alias(n) for n, c in zip(("even", "odd"), popcounts(F.col("fingerprint")))])
    counted = embedded.select("fingerprint", *[_block_of(F.col("even"), F.col("odd"), i, blocks).alias(f"part{i}") for i in range(blocks)])
    return counted.select("fingerprint", F.explode(F.array(*[cell(n, c) for n, c in enumerate(_grids(distance, blocks))])).alias("cell"))


def _pairs(left: DataFrame, right: DataFrame, distance: int, blocks: int) -> DataFrame:
    """Pairs ``a, b`` of a common cell: within the lower bound, then within the exact distance, and each in
    the first only of the cells it shares, that of the first blocks on which its counts agree."""
    both = left.withColumnRenamed("fingerprint", "a").join(right.withColumnRenamed("fingerprint", "b"), "cell")
    a, b = popcounts(F.col("a")), popcounts(F.col("b"))
    near = (manhattan(a, b) <= distance) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    keep = _grids(distance, blocks)
    same = [(_block_of(*a, i, blocks) == _block_of(*b, i, blocks)).cast("int") for i in range(blocks)]
    agreeing = sum((F.shiftleft(s, i) for i, s in enumerate(same)), F.lit(0))
    first = []
    for mask in range(1 << blocks):
        on = [i for i in range(blocks) if mask >> i & 1]
        first.append(keep.index(tuple(on[: blocks - distance])) if len(on) >= blocks - distance else -1)
    width = 2 * SEGMENTS // blocks * (blocks - distance)
    here = F.shiftright("cell", width) == F.get(F.array(*map(F.lit, first)), agreeing)
    return both.where((F.col("a") < F.col("b") if left is right else F.col("a") != F.col("b")) & near & here)


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, hot_cell: int = HOT_CELL) -> DataFrame:
    """``a < b``: pairs of the distinct ``fingerprint`` values of ``prints`` (no nulls; repeated ones count
    once) that differ in at most ``distance`` bits, each once: all such pairs, but for those of two
    fingerprints that a hot cell's group joins by other links, so that components are those of all pairs.
    Other columns are ignored; an empty table gives none."""
    # a fingerprint becomes a row for each grid: dealt to all tasks before, however small the table is
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = _points(prints.select("fingerprint").distinct().repartition(parts, "fingerprint"), distance, blocks)
    hot = _hot_cells(points, prints.count() * len(_grids(distance, blocks)), hot_cell)
    if hot is None:
        return _pairs(points, points, distance, blocks).select("a", "b")
    cool = points.join(hot, "cell", "left_anti")
    found = _pairs(cool, cool, distance, blocks).select("a", "b")
    warm = saved(points.join(hot, "cell"), "hot-cells")
    stars = saved(_one_bit_stars(warm.select("fingerprint").distinct()), "stars")
    groups = components(stars).withColumnRenamed("node", "fingerprint")
    known = saved(warm.join(groups, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")), "hot-groups")
    largest = known.groupBy("cell", "root").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    placed = known.join(largest, "cell")
    others = placed.where("root <> most").select("cell", "fingerprint", F.col("root").alias("root_a"))
    # two of the others meet from both sides, and count from one
    between = _pairs(others, placed, distance, blocks).where("root_a <> root and (root = most or a < b)")
    return found.unionByName(between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).unionByName(stars).distinct()


def _hot_cells(points: DataFrame, total: int, hot_cell: int) -> DataFrame | None:
    """``cell`` of all cells of more than ``hot_cell`` points, None without any. Cells are counted by a hash of
    them first, in buckets of half as many points on the average: a hot cell's bucket is full too, and only the
    cells of full buckets are counted themselves."""
    bucket = F.pmod(F.xxhash64("cell"), F.lit(2 * total // hot_cell + 1)).alias("bucket")
    full = saved(points.groupBy(bucket).agg(F.count("*").alias("n")).where(F.col("n") > hot_cell).select("bucket"), "buckets")
    if not full.take(1):
        return None
    inside = points.select("cell", bucket).join(full, "bucket", "left_semi")
    hot = saved(inside.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > hot_cell).select("cell"), "cells")
    return hot if hot.take(1) else None


def _one_bit_stars(prints: DataFrame) -> DataFrame:
    """``a < b``: each fingerprint and the smallest that differs from it in one bit, for each bit: the one of a
    pair with the bit clear. No more than 64 rows a fingerprint, whatever their number."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    keyed = prints.select("fingerprint", bit).withColumn("rest", F.expr("fingerprint & ~shiftleft(1L, bit)"))
    both = keyed.groupBy("bit", "rest").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b"))
    return both.where("a < b").select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)`` (no nulls; repeated edges count once): the smallest
    node that is reachable. An edge of a node with itself is none. An empty table gives none. Large-star and small-star rounds; each is written to the shared folder, so that lineage stays
    short, and the driver sees only a count and a checksum."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        )
        now = saved(small, "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _classified(docs: DataFrame, distance: int, blocks: int) -> DataFrame:
    """fingerprints() with ``least``: id and text_hash of the component's first row."""
    prints = saved(fingerprints(docs), "fingerprints")
    # a null id is the least long, but comes after all others as a component's id
    order = F.struct((F.col("id") == NO_ID).alias("unknown"), "id", "text_hash")
    classes = saved(prints.groupBy("fingerprint").agg(F.min(order).alias("least"), F.count("*").alias("copies")), "prints")
    roots = components(links(classes, distance, blocks))
    least = roots.join(classes.select(F.col("fingerprint").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("lowest"))
    named = roots.join(least, "root").select(F.col("node").alias("fingerprint"), "lowest")
    # a row for each fingerprint, so that a large group of copies meets one row; fingerprints with a share of
    # 1 / HOT_KEYS of all rows or more are HOT_KEYS at most, and broadcast
    to = classes.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("lowest", "least").alias("least"), "copies")
    to, total = saved(to, "classes"), prints.count()
    return join_hot_apart(prints, to, ["fingerprint"], "least", F.col("copies") * HOT_KEYS >= total).drop("copies")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, fingerprint (16 hex digits), component_id`` for each row of ``docs``.

    component_id is the smallest doc_id that is reachable over links, the row's own included. Rows
    without words (null or empty texts) have fingerprint zero and are linked like any other. A null
    doc_id takes part in links but is a component's id only where the component has no other.
    Repeated rows stay. Columns other than ``doc_id`` and ``text`` are not looked at; an empty table
    gives no rows.
    """
    back = lambda c: F.nullif(c, F.lit(NO_ID))
    return _classified(docs, distance, blocks).select(
        back(F.col("id")).alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), back(F.col("least.id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, and of the smallest hash of
    its text among rows of that doc_id; of repeated rows one. A null doc_id stays only where its component
    has no other. Texts without words (null, empty) are one component. Columns stay as they were, whatever
    their names; an empty table gives none."""
    found = _classified(docs, distance, blocks)
    first = (F.col("id") == F.col("least.id")) & (F.col("text_hash") == F.col("least.text_hash"))
    g_id, g_hash, own_id, own_hash = unused(docs.columns, "g_id", "g_hash", "own_id", "own_hash")
    gone = found.where(~first).select(F.col("id").alias(g_id), F.col("text_hash").alias(g_hash)).distinct()
    repeated = found.where(first).groupBy("id", "text_hash").count().where("count > 1").take(1)
    ready = docs.select(*columns_of(docs), F.coalesce("doc_id", F.lit(NO_ID)).alias(own_id), F.xxhash64("text").alias(own_hash))
    kept = ready.join(gone, (F.col(own_id) == F.col(g_id)) & (F.col(own_hash) == F.col(g_hash)), "left_anti")
    return (kept.dropDuplicates([own_id, own_hash]) if repeated else kept).select(*columns_of(docs))
