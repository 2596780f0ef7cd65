"""Boosted trees on absolute errors: a whole search over cells and folds as one Spark job of many fits.

Trees are grown by histograms of the errors' signs, and a leaf's value is the exact median of the errors in it, which lowers
the absolute error itself. Fits see all training rows. Up to MOST_ROWS of them the search is spread by fit: rows are broadcast
once, and each task grows the trees of one cell and fold. More rows are spread in blocks (``_grow_spread``), and the cells of a
fold grow side by side, level by level, from sums over blocks: the same trees, whichever way they are grown. All rows are
scored, in parallel, by all fits at once; cells that differ in their number of trees alone are one fit, read at several
lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from tidemark.sources.tables import saved

from .forecast import cells, complete_parts
from .quantiles import ranked_values

# The search grid (36 cells).
GRID = {"max_depth": [3, 4, 5], "n_estimators": [200, 400], "learning_rate": [0.03, 0.05, 0.1], "subsample": [0.8, 1.0]}
#: Rows that one task fits at most: more are fitted in blocks. Rows of a block, rows that are summed at once, and bins of a feature
#: (whose numbers are bytes).
MOST_ROWS, BLOCK_ROWS, AT_ONCE, BINS = 400_000, 200_000, 1 << 16, 256
#: Of a fit in blocks: values of a leaf that a task sends at most at once, trees after which predictions are held, and written.
PIVOTS, HELD, WRITTEN = 1024, 4, 40
#: Depth of a tree at most: it is held as a complete one.
MOST_DEPTH = 8


@dataclass
class Trees:
    """Trees of one depth as rows of arrays: a node's feature and bound (right if above), the leaves' values, and what
    each node's split gained. ``start``: the prediction before the first tree."""

    start: float
    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def stages(self, x: np.ndarray, ends: list[int]) -> Iterator[np.ndarray]:
        """Predictions after each of some numbers of trees, ascending."""
        made, row, done = np.full(len(x), self.start), np.arange(len(x)), 0
        depth = int(np.log2(self.value.shape[1]))
        for end in ends:
            for t in range(done, min(end, len(self.value))):
                node = np.zeros(len(x), np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (x[row, self.feature[t, node]] > self.bound[t, node])
                made = made + self.value[t, node - (2**depth - 1)]
            done = end
            yield made


def _medians(values: np.ndarray, leaf: np.ndarray, leaves: int) -> np.ndarray:
    by = values[np.argsort(leaf.astype(np.uint16), kind="stable")]  # a leaf's values side by side, in no order
    ends = np.cumsum(np.bincount(leaf, minlength=leaves)).tolist()
    out = np.zeros(leaves)
    for k, (i, j) in enumerate(zip([0, *ends], ends)):
        if j > i:
            middle = sorted({(j - i - 1) // 2, (j - i) // 2})
            part = np.partition(by[i:j], middle)
            out[k] = (part[middle[0]] + part[middle[-1]]) / 2
    return out


def _best(left: np.ndarray, n_left: np.ndarray, all_: np.ndarray, n_all: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's first best bin and its gain, from sums of signs and counts up to each bin and of the node (all are used up)."""
    # left**2 / (n_left + 1) + (all_ - left)**2 / (n_all - n_left + 1) - all_**2 / (n_all + 1), in place; 0 where a side has no rows
    gain = left * left
    gain /= np.add(n_left, 1, out=n_left)
    right = np.subtract(all_, left, out=left)
    right *= right
    right /= np.subtract(n_all + 2, n_left, out=n_left)
    gain += right
    gain -= all_**2 / (n_all + 1)
    best = gain.argmax(axis=1)
    return best, gain[np.arange(len(best)), best]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    bins = np.empty(x.shape, np.uint8)
    for i, e in enumerate(edges):
        bins[:, i] = np.searchsorted(e, x[:, i], "left")
    return bins


def _sums(bins: np.ndarray, first: np.ndarray, node: np.ndarray, weight: np.ndarray, nodes: int, size: int) -> np.ndarray:
    """Sums of rows' weights in each bin of each node, ``AT_ONCE`` rows at a time."""
    out = np.zeros(nodes * size)
    for i in range(0, len(bins), AT_ONCE):
        some = slice(i, i + AT_ONCE)
        out += np.bincount((bins[some] + (node[some, None] * size + first)).ravel(), np.repeat(weight[some], bins.shape[1]), nodes * size)
    return out


def grow(x: np.ndarray, y: np.ndarray, max_depth: int, n_estimators: int, learning_rate: float, subsample: float, seed: int = 42) -> Trees:
    """``n_estimators`` trees on rows ``x`` and labels ``y``. A split's gain is that of squared sums of signs over counts
    plus one; of equal gains the first feature and lowest bound win; a node without gain keeps its rows together."""
    if not 1 <= max_depth <= MOST_DEPTH:
        raise ValueError(f"a depth of 1 to {MOST_DEPTH}")
    n, p = x.shape
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    # bins of all features are numbered through; above a feature's last bin there is no bound
    width = np.array([len(e) + 1 for e in edges])
    size, feature, first = int(width.sum()), np.repeat(np.arange(p), width), np.cumsum(width) - width
    bound = np.concatenate([[*e, np.inf] for e in edges])
    bins = _binned(x, edges)
    rng, inner, leaves = np.random.default_rng(seed), 2**max_depth - 1, 2**max_depth
    out = Trees(float(np.median(y)), np.zeros((n_estimators, inner), np.int32), np.full((n_estimators, inner), np.inf), np.zeros((n_estimators, leaves)), np.zeros((n_estimators, inner)))
    made, row = np.full(n, out.start), np.arange(n)
    # a row's weight holds its sign and, far above it, a one, so that one sum of them (whole numbers below 2**53) is both
    one = float(1 << (n.bit_length() + 1))
    if p * n * one >= 2**53:
        raise ValueError("too many rows for one fit")
    for t in range(n_estimators):
        rest = y - made
        mine = row if subsample >= 1 else np.flatnonzero(rng.random(n) < subsample)
        own = bins if subsample >= 1 else bins[mine]
        weight = np.sign(rest[mine]) + one
        node = np.zeros(n, np.int64)
        for level in range(max_depth):
            nodes, base = 2**level, 2**level - 1
            below = _sums(own, first, node[mine], weight, nodes, size).reshape(nodes, size).cumsum(axis=1)
            whole = below[:, width[0] - 1, None].copy()  # each feature's bins hold all of a node's rows
            below -= feature * whole
            n_left, n_all = np.rint(below / one), np.rint(whole / one)
            left, all_ = np.subtract(below, n_left * one, out=below), whole - n_all * one
            best, won = _best(left, n_left, all_, n_all)
            f = np.where(won > 1e-12, feature[best], 0)
            cut = np.where(won > 1e-12, best - first[f], BINS)
            out.feature[t, base : base + nodes] = f
            out.bound[t, base : base + nodes] = np.where(won > 1e-12, bound[best], np.inf)
            out.gain[t, base : base + nodes] = np.maximum(won, 0)
            node = 2 * node + (bins[row, f[node]] > cut[node])
        out.value[t] = learning_rate * _medians(rest[mine], node[mine], leaves)
        made += out.value[t, node]
    return out


@dataclass
class TreesModel:
    """``transform`` adds ``prediction``: null where a feature is."""

    features: list[str]
    trees: Trees
    n_estimators: int

    def transform(self, df: DataFrame) -> DataFrame:
        trees, end = self.trees, [self.n_estimators]

        @arrow_udf(DoubleType())
        def predict(*columns: pa.Array) -> pa.Array:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
            (made,) = trees.stages(x, end)
            return pa.array(made, mask=np.isnan(x).any(axis=1))

        return df.withColumn("prediction", predict(*[F.col(c).cast("double") for c in self.features]))

    def importances(self) -> list[tuple[str, float]]:
        """Each feature's share of what all splits gained, largest first."""
        gain = np.zeros(len(self.features))
        np.add.at(gain, self.trees.feature[: self.n_estimators].ravel(), self.trees.gain[: self.n_estimators].ravel())
        return sorted(zip(self.features, (gain / (gain.sum() or 1.0)).tolist()), key=lambda r: (-r[1], r[0]))


_ARRAYS = {"feature": "array<int>", "bound": "array<double>", "value": "array<double>", "gain": "array<double>"}


def _fits(spark, sample: tuple, runs: list[tuple[int, int, dict]]) -> dict[tuple[int, int], Trees]:
    """The trees of each ``(fold, run, cell)``, one a task, on the sample's rows of parts before the fold."""
    shared = spark.sparkContext.broadcast(sample)
    table = spark.createDataFrame([(k, fold, run, str(k)) for k, (fold, run, _) in enumerate(runs)], "k int, fold int, run int, name string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, part = shared.value
        for frame in frames:
            for r in frame.itertuples():
                mine = part < r.fold
                made = grow(x[mine], y[mine], **runs[r.k][2])
                yield pd.DataFrame([(r.fold, r.run, made.start, *[getattr(made, a).ravel().tolist() for a in _ARRAYS])], columns=["fold", "run", "start", *_ARRAYS])

    made = table.repartitionByRange(len(runs), "k").mapInPandas(run, "fold int, run int, start double, " + ", ".join(f"{a} {k}" for a, k in _ARRAYS.items()))
    out = {}
    for r in made.collect():  # bounded by the grid and the trees' sizes
        n = next(c["n_estimators"] for f, i, c in runs if (f, i) == (r["fold"], r["run"]))
        out[r["fold"], r["run"]] = Trees(r["start"], *[np.array(r[a]).reshape(n, -1) for a in _ARRAYS])
    shared.unpersist()
    return out


def _sample(rows: DataFrame) -> DataFrame:
    """All rows, or MOST_ROWS of them by a hash of series and time, for a look at a large table. No search fits on it."""
    n, whole = rows.count(), 1 << 40
    if n <= MOST_ROWS:
        return rows
    drawn = rows.withColumn("__draw", F.pmod(F.xxhash64("series_id", "timestamp_utc"), F.lit(whole)))
    near = drawn.where(F.col("__draw") < int(whole * min(1.0, (MOST_ROWS + 10 * MOST_ROWS**0.5) / n)))
    return near.orderBy("__draw", "series_id", "timestamp_utc").limit(MOST_ROWS).drop("__draw")


# --- fits of more rows than a task should hold


def _arrays(batches: Iterator[pa.RecordBatch], **types: type) -> Iterator[dict]:
    """Rows of a table of blocks, binary columns as arrays of the types given."""
    for b in batches:
        for i in range(b.num_rows):
            yield {c: np.frombuffer(b.column(c)[i].as_buffer(), types[c]) if c in types else b.column(c)[i].as_py() for c in b.schema.names}


def _blocks(rows: DataFrame, columns: list, n: int) -> DataFrame:
    """Rows in the order of time and series, those of a partition as one row of arrays; blocks ascend in that order."""
    parts, order = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK_ROWS)), ["timestamp_utc", "series_id"]
    placed = rows.repartitionByRange(parts, *order).withColumn("block", F.spark_partition_id()).sortWithinPartitions(*order).select("block", "part", *columns)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            block, part, *x, y = [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            yield pa.RecordBatch.from_pydict({"block": pa.array(block[:1], pa.int32()), "part": [part.tobytes()], "x": [np.column_stack(x).tobytes()], "y": [y.tobytes()]})

    return saved(placed.mapInArrow(packed, "block int, part binary, x binary, y binary"))


def _edges(rows: DataFrame, columns: list) -> tuple[list[np.ndarray], float]:
    """Each feature's bounds of bins, and the label's median, as grow() finds them in all rows."""
    long = rows.select(F.posexplode(F.array(*columns)).alias("feature", "value"))
    ranked, last = ranked_values(long, ["feature"], "value"), F.col("total") - 1
    stands = lambda place: (F.col("first") <= place) & (place < F.col("first") + F.col("n"))
    # bounds stand at the places last * i div BINS, and the first of them from a value's first place on is that of this i
    i = F.greatest(F.lit(1), F.ceil(F.col("first") * BINS / F.greatest(last, F.lit(1))))
    a_bound = (i < BINS) & stands(F.floor(last * i / BINS))
    label = len(columns) - 1
    low, high = stands(F.floor(last / 2)), stands(F.floor((last + 1) / 2))
    found = ranked.select("feature", "value", low.alias("low"), high.alias("high")).where(F.when(F.col("feature") == label, low | high).otherwise(a_bound)).toPandas()  # as many as bins
    y = found[found.feature == label]
    return [np.sort(found.value[found.feature == i].to_numpy()) for i in range(label)], float((y.value[y.low].iloc[0] + y.value[y.high].iloc[0]) / 2)


def _leaf_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row is in below some levels of a tree whose bounds are numbers of bins."""
    node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for level in range(levels):
        at = node + 2**level - 1
        node = 2 * node + (bins[row, feature[at]] > cut[at])
    return node


def _places(m: int, most: int) -> np.ndarray:
    """Places of ``m`` ordered values: all, or ``most`` in equal steps with both ends."""
    return np.arange(m) if m <= most else np.arange(most) * (m - 1) // (most - 1)


def _pivots(values: np.ndarray, lo: float, hi: float, most: int) -> tuple[tuple[int, int, int], np.ndarray]:
    """Of a block's values of a leaf: how many are below ``lo``, equal to it, and between it and ``hi``; and of those between,
    in order, the ones at _places()."""
    inner = np.sort(values[(values > lo) & (values < hi)])
    return (int((values < lo).sum()), int((values == lo).sum()), len(inner)), inner[_places(len(inner), most)]


def _narrowed(counts: np.ndarray, pivots: list[np.ndarray], lo: float, hi: float, n: int, most: int) -> tuple[float, float, int, float]:
    """What blocks' _pivots() say of a leaf of ``n`` values (-1: not counted yet): closer bounds around both middle values, their
    number, and the median once it is sure, else NaN. Pivots have known places in their block, which bounds how many
    values are below and up to each of them."""
    below, same, between = counts.sum(axis=0).tolist()
    n = between if n < 0 else n
    if not n:
        return lo, hi, n, 0.0
    whole, ends = all(len(p) == m for p, m in zip(pivots, counts[:, 2])), []
    for place in ((n - 1) // 2, n // 2):
        k = place - below - same
        if k < 0 or k >= between:
            ends.append((lo, lo) if k < 0 else (hi, hi))
        elif whole:
            ends.append((float(np.sort(np.concatenate(pivots))[k]),) * 2)
        else:
            a = np.unique(np.concatenate(pivots))
            places = [_places(m, most) for m in counts[:, 2]]
            less = sum(np.append(at, m)[np.searchsorted(p, a, "left")] for p, at, m in zip(pivots, places, counts[:, 2]))
            upto = sum(np.append(0, at + 1)[np.searchsorted(p, a, "right")] for p, at in zip(pivots, places))
            ends.append((float(a[less <= k].max()), float(a[upto > k].min())))
    sure = all(x == y for x, y in ends)
    return min(x for x, _ in ends), max(y for _, y in ends), n, (ends[0][0] + ends[1][0]) / 2 if sure else np.nan


_STATE = "block int, n int, bins binary, y binary, made binary"


def _grow_spread(blocks: DataFrame, rows: DataFrame, columns: list, fold: int, grid: list[dict], seed: int = 42) -> list[Trees]:
    """grow() for each cell of ``grid`` on all rows of parts before the fold, which lie in _blocks(). The cells' trees grow side by
    side: a level is a job that sums signs and counts over blocks and picks each node's split, and exact medians of leaves
    take a few more, each of which counts around closer bounds. A fit's sums, pivots and trees come together, never its rows;
    predictions stay with the blocks. A row's draw has the place in grow()'s stream that the row has in the order of all."""
    spread = max(1, blocks.sparkSession.sparkContext.defaultParallelism)
    edges, start = _edges(rows.where(F.col("part") < fold), columns)
    p, fits, most = len(edges), len(grid), PIVOTS
    width = np.array([len(e) + 1 for e in edges])
    size, feature, first = int(width.sum()), np.repeat(np.arange(p), width), np.cumsum(width) - width
    bound, never = np.concatenate([[*e, np.inf] for e in edges]), BINS

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _arrays(batches, part=np.int32, x=np.float64, y=np.float64):
            mine = b["part"] < fold
            if n := int(mine.sum()):
                yield _row(block=b["block"], n=n, bins=_binned(b["x"].reshape(len(mine), p)[mine], edges), y=b["y"][mine], made=np.full((fits, n), start))

    state = saved(blocks.mapInArrow(fitted, _STATE))
    sizes = sorted((r["block"], r["n"]) for r in state.select("block", "n").collect())  # a row a block
    total = sum(n for _, n in sizes)
    before = dict(zip([b for b, _ in sizes], np.cumsum([0, *[n for _, n in sizes]]).tolist()))
    shapes = [(c["n_estimators"], 2 ** c["max_depth"]) for c in grid]
    out = [Trees(start, np.zeros((n, k - 1), np.int32), np.full((n, k - 1), np.inf), np.zeros((n, k)), np.zeros((n, k - 1))) for n, k in shapes]
    cuts = [np.full((n, k - 1), never, np.int32) for n, k in shapes]
    done, kept = 0, None

    def stage(t: int, level: int, live: list[int]) -> Callable[[dict], Iterator[tuple]]:
        """Of a block, for each live fit: its number, predictions before tree ``t``, rows that the tree is grown on, and nodes at
        a level of it."""
        since = {i: (out[i].feature[done : t + 1].copy(), cuts[i][done : t + 1].copy(), out[i].value[done:t].copy()) for i in live}

        def of(b: dict) -> Iterator[tuple]:
            bins, made, drawn = b["bins"].reshape(-1, p), b["made"].reshape(fits, -1), {}
            for i in live:
                f, cut, value = since[i]
                now, depth, share = made[i], grid[i]["max_depth"], grid[i]["subsample"]
                for u, v in enumerate(value):
                    now = now + v[_leaf_of(bins, f[u], cut[u], depth)]
                if share not in drawn:
                    stream = np.random.Generator(np.random.PCG64(seed).advance(t * total + before[b["block"]]))
                    drawn[share] = np.arange(b["n"]) if share >= 1 else np.flatnonzero(stream.random(b["n"]) < share)
                yield i, now, drawn[share], _leaf_of(bins, f[-1], cut[-1], min(level, depth)) if len(f) > len(value) else None

        return of

    def summed(of: Callable, nodes: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in _arrays(batches, bins=np.uint8, y=np.float64, made=np.float64):
                bins, one = b["bins"].reshape(-1, p), float(1 << (b["n"].bit_length() + 1))
                for i, made, mine, node in of(b):
                    held = _sums(bins[mine], first, node[mine], np.sign(b["y"][mine] - made[mine]) + one, nodes, size)
                    n = np.rint(held / one)
                    sums.setdefault(i, np.zeros((2, nodes * size)))
                    sums[i] += held - n * one, n
            for i, (signs, counts) in sums.items():
                yield _row(fit=i, signs=signs, counts=counts)

        return run

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        left, n_left = (sum(np.frombuffer(b) for b in frame[c]).reshape(-1, size).cumsum(axis=1) for c in ("signs", "counts"))
        all_, n_all = left[:, width[0] - 1, None].copy(), n_left[:, width[0] - 1, None].copy()
        left -= feature * all_
        n_left -= feature * n_all
        best, won = _best(left, n_left, all_, n_all)
        return pd.DataFrame({"fit": [int(frame["fit"].iloc[0])], "best": [best.tolist()], "won": [won.tolist()]})

    def offered(of: Callable, bounds: dict[int, tuple]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _arrays(batches, bins=np.uint8, y=np.float64, made=np.float64):
                for i, made, mine, node in of(b):
                    leaf, (lo, hi, _) = node[mine], bounds[i]
                    by = (b["y"][mine] - made[mine])[np.argsort(leaf.astype(np.uint16), kind="stable")]
                    held = [_pivots(v, lo[k], hi[k], most) for k, v in enumerate(np.split(by, np.cumsum(np.bincount(leaf, minlength=len(lo)))[:-1]))]
                    yield _row(fit=i, counts=np.array([c for c, _ in held]), pivots=np.concatenate([v for _, v in held]))

        return run

    def narrow(bounds: dict[int, tuple]) -> Callable:
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            i = int(frame["fit"].iloc[0])
            counts = np.stack([np.frombuffer(b, np.int64).reshape(-1, 3) for b in frame["counts"]])
            pivots = [np.split(np.frombuffer(b), np.cumsum(np.minimum(c[:, 2], most))[:-1]) for b, c in zip(frame["pivots"], counts)]
            made = [_narrowed(counts[:, k], [v[k] for v in pivots], lo, hi, n, most) for k, (lo, hi, n) in enumerate(zip(*bounds[i]))]
            return pd.DataFrame({"fit": [i], **{c: [list(v)] for c, v in zip(("lo", "hi", "n", "median"), zip(*made))}})

        return run

    def moved(of: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _arrays(batches, bins=np.uint8, y=np.float64, made=np.float64):
                made = b["made"].reshape(fits, -1).copy()
                for i, now, _, _ in of(b):
                    made[i] = now
                yield _row(**{**b, "made": made})

        return run

    last = max(n for n, _ in shapes)
    for t in range(last):
        live = [i for i in range(fits) if t < shapes[i][0]]
        for level in range(max(grid[i]["max_depth"] for i in live)):
            base, nodes = 2**level - 1, 2**level
            sums = state.mapInArrow(summed(stage(t, level, [i for i in live if grid[i]["max_depth"] > level]), nodes), "fit int, signs binary, counts binary")
            for r in sums.repartition(spread, "fit").groupBy("fit").applyInPandas(split, "fit int, best array<int>, won array<double>").collect():  # a row a fit
                best, won, tree = np.array(r["best"]), np.array(r["won"]), out[r["fit"]]
                good = won > 1e-12
                tree.feature[t, base : base + nodes] = f = np.where(good, feature[best], 0)
                tree.bound[t, base : base + nodes] = np.where(good, bound[best], np.inf)
                tree.gain[t, base : base + nodes] = np.maximum(won, 0)
                cuts[r["fit"]][t, base : base + nodes] = np.where(good, best - first[f], never)
        bounds = {i: (np.full(shapes[i][1], -np.inf), np.full(shapes[i][1], np.inf), np.full(shapes[i][1], -1)) for i in live}
        while bounds:
            pivots = state.mapInArrow(offered(stage(t, MOST_DEPTH, list(bounds)), bounds), "fit int, counts binary, pivots binary")
            found = pivots.repartition(spread, "fit").groupBy("fit").applyInPandas(narrow(bounds), "fit int, lo array<double>, hi array<double>, n array<long>, median array<double>").collect()  # a row a fit
            for r in found:
                lo, hi, n, median = (np.array(r[c], k) for c, k in (("lo", float), ("hi", float), ("n", int), ("median", float)))  # null: not sure
                sure = ~np.isnan(median)
                out[r["fit"]].value[t, sure] = grid[r["fit"]]["learning_rate"] * median[sure]
                bounds[r["fit"]] = np.where(sure, median, lo), np.where(sure, median, hi), n
                if sure.all():
                    del bounds[r["fit"]]
        if (t + 1) % HELD == 0 and t + 1 < last:
            after = state.mapInArrow(moved(stage(t + 1, 0, live)), _STATE)
            if (t + 1) % WRITTEN == 0:
                after = saved(after)
            else:
                after.persist(StorageLevel.DISK_ONLY).count()
            if kept:
                kept.unpersist()
            state, kept, done = after, None if (t + 1) % WRITTEN == 0 else after, t + 1
    if kept:
        kept.unpersist()
    return out


def _row(**values) -> pa.RecordBatch:
    """A row; arrays become bytes."""
    return pa.RecordBatch.from_pydict({c: pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else pa.array([v], pa.int32()) for c, v in values.items()})


def _fits_spread(blocks: DataFrame, rows: DataFrame, columns: list, runs: list[tuple[int, int, dict]]) -> dict[tuple[int, int], Trees]:
    """_fits() on blocks: folds grow at the same time, each as its own jobs."""
    folds = sorted({fold for fold, _, _ in runs})
    of = {fold: [(run, cell) for f, run, cell in runs if f == fold] for fold in folds}
    grown = inheritable_thread_target(blocks.sparkSession)(lambda fold: _grow_spread(blocks, rows, columns, fold, [c for _, c in of[fold]]))
    with ThreadPoolExecutor(len(folds)) as pool:
        return {(fold, run): trees for fold, made in zip(folds, pool.map(grown, folds)) for (run, _), trees in zip(of[fold], made)}


def search(df: DataFrame, features: list[str], label: str, grid: list[dict] | None = None, k: int = 3, unit: str = "days") -> tuple[TreesModel, dict, DataFrame]:
    """forecast.search() for boosted trees: the cell with the lowest mean over folds of the mean absolute error, refitted
    on all rows; the model, the cell, and a table ``cell, fold, mae, parameters``.

    Folds are cut between local days (``unit``). ``grid``: cells of ``max_depth``, ``n_estimators``, ``learning_rate`` and
    ``subsample`` (default: GRID's 36). Fits see all rows before their fold, errors are those of all rows of it. Rows that lack
    a feature or the label are left out; the errors of forecast.complete_parts() are raised."""
    spark, grid = df.sparkSession, grid or cells(**GRID)
    rows = complete_parts(df, features, label, k, unit)
    columns = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, label])]
    n = rows.count()
    if n <= MOST_ROWS:
        held = rows.orderBy("timestamp_utc", "series_id").select("part", *columns).toPandas()
        fits = partial(_fits, spark, (held.iloc[:, 1:-1].to_numpy(), held.iloc[:, -1].to_numpy(), held["part"].to_numpy()))
    else:
        fits = partial(_fits_spread, _blocks(rows, columns, n), rows, columns)
    alike = lambda c: (c["max_depth"], c["learning_rate"], c["subsample"])
    kinds = sorted({alike(c) for c in grid})
    longest = {x: max(c["n_estimators"] for c in grid if alike(c) == x) for x in kinds}
    whole = lambda x: dict(zip(("max_depth", "learning_rate", "subsample"), x)) | {"n_estimators": longest[x]}
    found = fits([(i, r, whole(x)) for i in range(k) for r, x in enumerate(kinds)])
    ends = [sorted({c["n_estimators"] for c in grid if alike(c) == x}) for x in kinds]
    shared = spark.sparkContext.broadcast(found)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], list[float]] = {}
        for b in batches:
            part = b.column(0).to_numpy()
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, b.num_columns)])
            for fold in np.unique(part):
                mine = part == fold
                for r in range(len(kinds)):
                    for end, made in zip(ends[r], shared.value[fold, r].stages(x[mine, :-1], ends[r])):
                        at = total.setdefault((int(fold), r, end), [0.0, 0])
                        at[0] += float(np.abs(made - x[mine, -1]).sum())
                        at[1] += int(mine.sum())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(*k, *v) for k, v in total.items()]), (pa.int32(),) * 3 + (pa.float64(), pa.int64()))], ["fold", "run", "trees", "total", "n"])

    scored = rows.where("part >= 0").select("part", *columns).mapInArrow(errors, "fold int, run int, trees int, total double, n long")
    maes = {(r["fold"], r["run"], r["trees"]): r["total"] / r["n"] for r in scored.groupBy("fold", "run", "trees").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()}
    shared.unpersist()
    of = lambda c, i: maes[i, kinds.index(alike(c)), c["n_estimators"]]
    means = [sum(of(c, i) for i in range(k)) / k for c in grid]
    best = grid[min(range(len(grid)), key=lambda c: (means[c], c))]
    last = fits([(k, 0, best)])[k, 0]
    table = spark.createDataFrame([(c, i, of(g, i), str(g)) for c, g in enumerate(grid) for i in range(k)], "cell int, fold int, mae double, parameters string")
    return TreesModel(features, last, best["n_estimators"]), best, table
