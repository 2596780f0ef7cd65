"""Boosted trees on absolute errors against a plain stump, and a search of several cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, forecast


def plain_stump(x, y):
    """The first best split by gain of signs, and the medians of both sides."""
    start = np.median(y)
    rest = y - start
    sign, best = np.sign(rest), (1e-12, None)
    for f in range(x.shape[1]):
        for bound in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= bound
            a, b, n, m = sign[left].sum(), sign[~left].sum(), left.sum(), (~left).sum()
            gain = a * a / (n + 1) + b * b / (m + 1) - (a + b) ** 2 / (n + m + 1)
            if gain > best[0] + 1e-12:
                best = (gain, (f, left))
    if best[1] is None:
        return np.full(len(y), start)
    left = best[1][1]
    return start + np.where(left, np.median(rest[left]), np.median(rest[~left]))


@pytest.mark.parametrize("seed", range(4))
def test_a_stump_equals_plain_python(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (80, 3)).astype(float)
    y = np.where(x[:, 1] > 5, 3.0, -1.0) + rng.normal(size=80) * (seed + 0.1)
    trees = boosting.grow(x, y, 1, 1, 1.0, 1.0)
    (made,) = trees.stages(x, [1])
    np.testing.assert_allclose(made, plain_stump(x, y))


def test_edge_cases_of_growing():
    x = np.ones((10, 2))
    same = boosting.grow(x, np.arange(10.0), 3, 5, 0.1, 1.0)  # nothing to split on: the median stays
    (made,) = same.stages(x, [5])
    np.testing.assert_allclose(made, 4.5)
    with pytest.raises(ValueError):
        boosting.grow(x, np.arange(10.0), 9, 1, 0.1, 1.0)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = x[:, 0] ** 2
    trees = boosting.grow(x, y, 3, 60, 0.2, 0.7)
    errors = [np.abs(m - y).mean() for m in trees.stages(x, [1, 20, 60])]
    assert errors[0] > errors[1] > errors[2]
    assert (boosting.grow(x, y, 3, 60, 0.2, 0.7).value == trees.value).all()  # reruns draw the same rows
    assert np.abs(boosting.grow(x, y, 3, 20, 0.2, 1.0).value - boosting.grow(x, y, 3, 60, 0.2, 1.0).value[:20]).max() == 0  # a longer fit holds the shorter


def test_sums_are_as_wide_as_the_bins_there_are(monkeypatch):
    """A feature of two values takes three bins of a node's sums, not as many as the widest feature; sums are made once a level."""
    asked, plain = [], np.bincount
    monkeypatch.setattr(boosting.np, "bincount", lambda key, weights=None, minlength=0: asked.append((len(key), minlength)) or plain(key, weights, minlength))
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=1000), rng.integers(0, 2, (1000, 20))])
    boosting.grow(x, x[:, 0] + x[:, 1], 2, 5, 0.1, 1.0)
    sums = [most for rows, most in asked if rows == 1000 * 21]
    assert len(sums) == 5 * 2 and max(sums) <= 2 * (boosting.BINS + 20 * 3)


def test_medians_of_leaves():
    rng = np.random.default_rng(4)
    values, leaf = np.round(rng.normal(size=500), 1), rng.integers(0, 40, 500)
    leaf[leaf == 7] = 8  # an empty leaf
    want = [np.median(values[leaf == k]) if (leaf == k).any() else 0.0 for k in range(40)]
    np.testing.assert_array_equal(boosting._medians(values, leaf, 40), want)


def table(spark, n=900):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3))
    y = np.sin(2 * x[:, 0]) * 3 + np.where(x[:, 1] > 0, x[:, 2], -x[:, 2]) * 2 + rng.standard_t(2, n) * 0.3
    rows = [("a", 1700000000 + 3600 * i, *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, t long, u double, v double, w double, y double").withColumn("timestamp_utc", F.timestamp_seconds("t"))


def test_search_picks_the_best_cell_and_beats_plain_fits(spark, monkeypatch):
    df = table(spark).cache()
    train, test = df.where(f"t < {1700000000 + 3600 * 700}"), df.where(f"t >= {1700000000 + 3600 * 700}")
    grid = forecast.cells(max_depth=[1, 4], n_estimators=[20, 120], learning_rate=[0.1], subsample=[0.8, 1.0])
    model, cell, scores = boosting.search(train, ["u", "v", "w"], "y", grid, 2)
    held = scores.toPandas()
    assert len(held) == 16 and grid[held.groupby("cell").mae.mean().idxmin()] == cell and cell["max_depth"] == 4 and cell["n_estimators"] == 120
    mae = lambda m: m.transform(test).select(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert mae(model) < mae(forecast.boosted_trees(train, ["u", "v", "w"], "y", maxDepth=4, maxIter=20, stepSize=0.1))
    top = model.importances()
    assert [(r["feature"], r["weight"]) for r in forecast.coefficients(model, ["u", "v", "w"]).collect()] == top
    assert abs(sum(w for _, w in top) - 1) < 1e-9 and {f for f, _ in top} == {"u", "v", "w"}
    assert model.transform(test.limit(1).withColumn("u", F.lit(None).cast("double"))).first()["prediction"] is None
    # a fold's error is that of its own rows by trees grown on the parts before
    rows = forecast.complete_parts(train, ["u", "v", "w"], "y", 2, "days").toPandas().sort_values("timestamp_utc")
    early, fold = rows[rows.part < 1], rows[rows.part == 1]
    (made,) = boosting.grow(early[["u", "v", "w"]].to_numpy(), early.y.to_numpy(), **grid[-1]).stages(fold[["u", "v", "w"]].to_numpy(), [120])
    assert abs(held[(held.cell == len(grid) - 1) & (held.fold == 1)].mae.iloc[0] - np.abs(made - fold.y).mean()) < 1e-9
    # fits see a bounded sample, errors are of all rows
    monkeypatch.setattr(boosting, "MOST_ROWS", 300)
    _, _, fewer = boosting.search(train, ["u", "v", "w"], "y", grid[:1], 2)
    assert fewer.count() == 2
    drawn = boosting._sample(rows_ := forecast.complete_parts(train, ["u", "v", "w"], "y", 2, "days"))
    assert drawn.count() == 300 and drawn.exceptAll(rows_).count() == 0 and boosting._sample(rows_).exceptAll(drawn).count() == 0


def test_search_refuses_what_it_cannot_judge(spark):
    df = table(spark, 300)
    with pytest.raises(ValueError, match="fewer"):
        boosting.search(df.limit(50), ["u"], "y")
    with pytest.raises(ValueError, match="twice"):
        boosting.search(df.unionByName(df), ["u"], "y")


@pytest.mark.parametrize("most", [3, 16])
def test_medians_of_blocks_equal_those_of_all_values(most):
    """Bounds close around both middle values, also of values that repeat, are few, or lie in one block."""
    rng = np.random.default_rng(most)
    whole = [rng.normal(size=n) for n in (0, 1, 2, 7, 500)] + [rng.integers(0, 3, 400).astype(float), np.repeat([1.0, 2.0], 50), np.ones(99)]
    for values in whole:
        blocks = np.split(values, np.sort(rng.integers(0, len(values) + 1, 4)))
        lo, hi, n, median, rounds = -np.inf, np.inf, -1, np.nan, 0
        while np.isnan(median):
            counts, pivots = zip(*[boosting._pivots(v, lo, hi, most) for v in blocks])
            lo, hi, n, median = boosting._narrowed(np.array(counts), list(pivots), lo, hi, n, most)
            rounds += 1
        assert n == len(values) and median == (np.median(values) if n else 0.0) and rounds <= 12


def test_more_rows_than_a_task_holds_give_the_same_trees(spark, monkeypatch):
    """All rows are fitted, however many: what is grown in blocks equals what is grown in one place."""
    df = table(spark, 700).withColumn("series_id", F.when(F.col("t") % 7200 == 0, "a").otherwise("b")).withColumn("v", F.round("v", 0)).cache()
    grid = [{"max_depth": d, "n_estimators": n, "learning_rate": 0.3, "subsample": s} for d, n, s in ((1, 3, 1.0), (3, 6, 0.8), (3, 4, 0.8))]
    plain, cell, errors = boosting.search(df, ["u", "v", "w"], "y", grid, 2)
    for name, value in (("MOST_ROWS", 90), ("PIVOTS", 8), ("HELD", 2), ("WRITTEN", 4)):
        monkeypatch.setattr(boosting, name, value)
    monkeypatch.setattr(boosting, "_fits", None)  # not used
    spread, same, others = boosting.search(df, ["u", "v", "w"], "y", grid, 2)
    assert cell == same == grid[1]
    np.testing.assert_array_equal(plain.trees.start, spread.trees.start)
    for name in boosting._ARRAYS:
        np.testing.assert_array_equal(getattr(plain.trees, name), getattr(spread.trees, name))
    want, got = [{(r.cell, r.fold): r.mae for r in t.collect()} for t in (errors, others)]
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
