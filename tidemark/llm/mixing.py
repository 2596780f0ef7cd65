"""Mixing sources to target weights by the cube method.

Each document of a source is to be taken ``target / source_size`` times: the whole part surely, the
fraction by balanced sampling. The flight phase moves the inclusion probabilities of a chunk of
documents along directions in the null space of two constraints, so that the expected words and
documents of the chunk stay as they are, until at most two of them are undecided. The undecided
of all chunks of a source meet in fewer chunks, and so on, until two at most are left for a source.
The landing phase rounds these so that the words come nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, columns_of, saved, unused

WEIGHTS, SHARE, CEILING = (5.0, 2.0, 1.0), 1.5, 2.0
#: Units of a chunk, and sources up to which their table is broadcast.
CHUNK, MOST_BROADCAST = 2048, 50_000


def targets(sized: DataFrame, weights: Iterable[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """``source, source_no, source_size, units, target`` for each source of ``sized (source, size)``.
    Sources in code point order, null last, weigh ``weights``, repeating. The targets share
    ``share`` of all sizes by weight; they stop at ``ceiling`` times their source's size, and the
    excess is shared anew until none is above."""
    spark = sized.sparkSession
    weights = [float(w) for w in weights]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    # a rank over all sources without bringing them into one task
    ranged = saved(totals.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "sources")
    before, at = {}, 0
    for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):
        before[part], at = at, at + n
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")] if before else F.lit(0)
    number = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + offset
    table = ranged.select("source", "source_size", "units", number.cast("long").alias("source_no"))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights)).cast("int"))
    table = saved(table.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(ceiling))), "ranked")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:  # the level (words a weight) rises; only sums come to the driver
        is_full = F.col("most") <= F.col("weight") * F.lit(level)
        n, full, left = table.agg(
            F.sum(is_full.cast("int")), F.sum(F.when(is_full, F.col("most")).otherwise(0.0)), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight")))
        ).first()
        if not left or n == stopped:
            break
        stopped, level = n, (share * total - full) / left
    return table.select(
        "source", "source_no", "source_size", "units", F.least(F.col("weight") * F.lit(level), F.col("most")).alias("target")
    )


def _direction(a: list[float], b: list[float]) -> tuple[float, ...]:
    """A direction along which the sums weighted by ``a`` and by ``b`` (three numbers each) stay the same."""
    move = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    top = max(map(abs, move))
    if top > 1e-9 * max(map(abs, a)) * max(map(abs, b)):
        return tuple(m / top for m in move)
    # the weights are in proportion (or one is all zero): what keeps the one that is not keeps both
    v = a if any(a) else b
    return (v[1], -v[0], 0.0) if v[0] or v[1] else (1.0, 0.0, 0.0)


def _flight(p: np.ndarray, amount: np.ndarray, rows: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Inclusion probabilities after the flight phase with the totals of ``amount`` (words) and of
    ``rows`` (documents) fixed; with ``land`` all of them 0 or 1."""
    p = p.astype(float).copy()
    draws = rng.random(len(p) + 1).tolist()
    eps = 1e-9
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    held: list[int] = []

    def undecided(i: int) -> bool:
        if p[i] <= eps:
            p[i] = 0.0
        elif p[i] >= 1 - eps:
            p[i] = 1.0
        else:
            return True
        return False

    for step, i in enumerate(np.flatnonzero((p > eps) & (p < 1 - eps)).tolist()):
        held.append(i)
        if len(held) < 3:
            continue
        move = _direction([float(amount[j]) for j in held], [float(rows[j]) for j in held])
        up = min(((1 - p[j]) / m if m > 0 else p[j] / -m) for j, m in zip(held, move) if m)
        down = min((p[j] / m if m > 0 else (1 - p[j]) / -m) for j, m in zip(held, move) if m)
        by = up if draws[step] * (up + down) < down else -down
        for j, m in zip(held, move):
            p[j] += by * m
        held = [j for j in held if undecided(j)]
    if land and held:
        want, docs = sum(p[j] * amount[j] for j in held), sum(p[j] * rows[j] for j in held)
        choices = [[n >> k & 1 for k in range(len(held))] for n in range(1 << len(held))]

        def off(x: list[int]) -> tuple:
            return abs(sum(v * amount[j] for v, j in zip(x, held)) - want), abs(sum(v * rows[j] for v, j in zip(x, held)) - docs), x

        for v, j in zip(min(choices, key=off), held):
            p[j] = float(v)
    return p


def _flyer(seed: int, level: int, names: list[str]):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "size"], kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, level, int(pdf["source_no"][0]), int(pdf["chunk"][0])])
        rows = pdf["rows"].to_numpy(float)
        p = _flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(float) * rows, rows, rng, bool(pdf["chunks"][0] <= 1))
        return pdf.assign(p=p)[names]

    return fly


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """A row for each unit: ``source, doc_id, text_hash, size, rows, source_size, target, copies``.

    A unit is all rows that agree in source, doc_id and text (they share one decision; a null is a
    value like any other). size: words between ASCII white space (null or empty text: 0). A source
    without words gets no copies; no unit gets more than ``ceiling`` copies, rounded up. The same
    rows and seed give the same plan, however they are partitioned. An empty table gives none.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")
    units = docs.select("source", "doc_id", F.xxhash64("text").alias("text_hash"), size.alias("size"))
    units = saved(units.groupBy("source", "doc_id", "text_hash", "size").agg(F.count("*").alias("rows")), "units")
    wanted = saved(targets(units.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, share, ceiling), "targets")
    few = wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    side = wanted.withColumnRenamed("source", "w_source").withColumn("times", F.least(times, F.lit(float(ceiling))))
    start = units.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    whole = F.floor(F.col("times") + 1e-9)
    start = start.withColumn("whole", whole).withColumn("p", F.greatest(F.col("times") - F.col("whole"), F.lit(0.0))).withColumn(
        "chunks", F.ceil(F.col("units") / chunk)
    ).drop("times", "units")
    schema = start.schema
    key = F.xxhash64("doc_id", "text_hash", F.lit(seed))
    done, level = [], 0
    most = math.ceil((wanted.agg(F.max("units")).first()[0] or 1) / chunk)
    now = start
    while True:

        chunked = now.withColumn("key", key).withColumn("chunk", F.pmod("key", F.greatest("chunks", F.lit(1))))
        flown = saved(chunked.groupBy("source_no", "chunk").applyInPandas(_flyer(seed, level, schema.names), schema), "flown")
        if most <= 1:
            done.append(flown)
            break
        decided = F.col("p").isin(0.0, 1.0) | (F.col("chunks") <= 1)
        done.append(flown.where(decided))
        now = flown.where(~decided).withColumn("chunks", F.ceil(F.col("chunks") * 2 / chunk))
        most, level = math.ceil(most * 2 / chunk), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(
        "source", "doc_id", "text_hash", "size", "rows", "source_size", "target", (F.col("whole") + F.round("p")).cast("long").alias("copies")
    )


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as many times as plan() has copies for it; columns as they were, whatever
    their names. Null ids, sources and texts are values like any other; all rows that agree in doc_id, source
    and text are taken equally often; a source without words, and an empty table, give no rows."""
    m_source, m_id, m_hash, m_copies, own_hash, copy = unused(docs.columns, "m_source", "m_id", "m_hash", "m_copies", "own_hash", "copy")
    copies = plan(docs, **how).where("copies > 0").select(
        F.col("source").alias(m_source), F.col("doc_id").alias(m_id), F.col("text_hash").alias(m_hash), F.col("copies").alias(m_copies)
    )
    left = docs.select(*columns_of(docs), F.xxhash64("text").alias(own_hash))
    both = left.join(
        copies, (F.col(own_hash) == F.col(m_hash)) & F.col("doc_id").eqNullSafe(F.col(m_id)) & F.col("source").eqNullSafe(F.col(m_source))
    )
    return both.select(*columns_of(docs), F.explode(F.sequence(F.lit(1), F.col(m_copies))).alias(copy)).drop(copy)
