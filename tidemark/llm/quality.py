"""Quality classifier: ridge regression on random Fourier features, then isotonic calibration.

A text becomes a vector of statistics. Random Fourier features (fixed seed) of the standardized
vector approximate a Gaussian kernel. Each partition sums its share of the normal equations; the sums
are added up and solved on the driver, where they have a fixed size. Rows that took no part in the
fit calibrate the ridge scores: binned, counted by Spark, and made monotone by pooling.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

FEATURES, RIDGE, SEED = 256, 1e-3, 20
#: Labelled rows used at most (those with the smallest hashes of doc_id), partitions that sum them.
TRAIN_ROWS, TRAIN_PARTS = 200_000, 16
#: Ridge scores are binned by this width between -1 and 2 for calibration.
BIN = 0.002
THRESHOLD = 0.7
STATISTICS = 21


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; all 0 for a null, empty or blank one."""
    words = (text or "").split()
    if not words:
        return [0.0] * STATISTICS
    data = text.encode("utf-8", "surrogatepass")
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, nw = len(data), len(words)
    upper, lower, digits = by[65:91].sum(), by[97:123].sum(), by[48:58].sum()
    wide, space = by[128:].sum(), by[32] + by[9:14].sum()
    stops = by[46] + by[44] + by[59] + by[58] + by[63] + by[39] + by[34] + by[45]
    symbols = n - upper - lower - digits - wide - space - stops
    lengths = np.fromiter(map(len, words), np.int64, nw)
    counts = Counter(words)
    twice = sum(map(str.__eq__, words, words[1:])) if nw > 1 else 0
    pairs = len(set(zip(words, words[1:]))) / (nw - 1) if nw > 1 else 1.0
    lines = text.split("\n")
    at = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = sum(not w[-1].isalnum() for w in words)
    bare = sum(not w[0].isalnum() for w in words)
    letters = max(1, upper + lower)
    return [
        np.log1p(n), np.log1p(nw), lengths.mean(), lengths.std(), lengths.max() ** 0.5, len(counts) / nw, len(counts) / nw**0.5,
        twice / nw, max(counts.values()) / nw, pairs, upper / letters, digits / n, symbols / n, by[33] / n, stops / n, wide / n,
        ends / nw, bare / nw, np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(at.mean()),
    ]


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, fold, stats`` for each row; fold: the CRC-32 of doc_id as text, modulo 4 (null: of "")."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "stats": [np.asarray(statistics(t), float) for t in b["text"]]})

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(run, "id string, stats array<double>")
    fold = (F.crc32(F.coalesce("id", F.lit(""))) % 4).cast("int")
    return rows.select(F.col("id").cast("long").alias("doc_id"), fold.alias("fold"), "stats")


class Model:
    """What scoring needs; small, and sent to the tasks with the function that uses it."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), features)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / self.w.shape[1])
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), *self.knots)


def isotonic(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending ``x``: centres and means of the blocks."""
    blocks: list[list[float]] = []
    for a, t, c in zip(x, total, count):
        blocks.append([a * c, t, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(rows: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the rows of described() with a label in ``labels (doc_id, quality)`` whose fold is not 2;
    folds 0 and 1 fit the ridge, fold 3 calibrates it. Several labels of a doc_id are averaged, null
    ones ignored. Without a label the score is 0.5 for all."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    known = rows.where("fold <> 2").join(marked, "doc_id").select("fold", "y", "stats", F.xxhash64("doc_id").alias("h"))
    known = saved(known, "labelled")
    n = known.count()
    if n > train_rows:
        known = known.where(F.col("h").cast("double") < -(2.0**63) + 2.0**64 * train_rows / n)
    if not n:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS))
    s = [F.get("stats", i) for i in range(STATISTICS)]
    at = known.agg(*[F.avg(c) for c in s], *[F.stddev_pop(c) for c in s]).first()
    model = Model(np.array(at[:STATISTICS]), np.maximum(np.array(at[STATISTICS:]), 1e-6))
    learn = known.where("fold < 2") if known.where("fold < 2").take(1) else known
    width = FEATURES + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width + 1))
        for b in batches:
            if len(b):
                z = model.features(np.vstack(b["stats"]))
                total += z.T @ np.hstack([z, b["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"total": [total.tobytes()]})

    # as many rows as TRAIN_PARTS, whatever the input's size
    total = sum(np.frombuffer(r[0]).reshape(width, width + 1) for r in learn.repartition(TRAIN_PARTS).mapInPandas(sums, "total binary").collect())
    size = total[-1, width - 1]
    model.weights = np.linalg.solve(total[:, :width] + RIDGE * size * np.diag([1.0] * FEATURES + [1e-9]), total[:, width])

    calibrate = known.where("fold = 3") if known.where("fold = 3").take(1) else learn
    bins = (
        _scored(calibrate, model.raw, "y double").groupBy(F.floor(F.greatest(F.least(F.col("value"), F.lit(2.0)), F.lit(-1.0)) / BIN).alias("bin"))
        .agg(F.sum("y"), F.count("*")).orderBy("bin").collect()
    )
    x, t, c = (np.array(v, float) for v in zip(*bins))
    model.knots = isotonic((x + 0.5) * BIN, t, c)
    return model


def _scored(rows: DataFrame, how, keep: str) -> DataFrame:
    names = [k.split()[0] for k in keep.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[names].assign(value=how(np.vstack(b["stats"])))

    return rows.select(*names, "stats").mapInPandas(run, f"{keep}, value double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    held_out: fold 2, whose labels are never read. score (0 to 1): that ``quality`` is 1, from whole
    texts only; null, empty and blank texts have the score of all-zero statistics. predicted: 1 from
    ``threshold`` on. Repeated rows stay; other columns are ignored; an empty table gives none.
    """
    rows = saved(described(docs), "described")
    model = fit(rows, labels)
    # doc_id as text through pandas, where a long with nulls would become a float
    named = rows.withColumn("id", F.col("doc_id").cast("string"))
    return _scored(named, model.score, "id string, fold int").select(
        F.col("id").cast("long").alias("doc_id"), (F.col("fold") == 2).alias("held_out"), F.col("value").alias("score"),
        (F.col("value") >= threshold).cast("int").alias("predicted"),
    )
