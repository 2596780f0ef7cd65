"""Elastic nets from sums of products against direct formulas, optimality conditions and Spark's own fits."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import forecast, linear


def table(spark, n=400, seed=1, offset=1e6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 50, 0.1] + [offset, -3, 0]
    y = 2 * (x[:, 0] - offset) - 0.05 * x[:, 1] + rng.normal(size=n)
    rows = [("s%d" % (i % 2), 1700000000 + 3600 * i, *map(float, x[i]), float(x[i, 0] - x[i, 1]), 5.0, float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, t long, a double, b double, c double, d double, e double, y double")
    return df.withColumn("timestamp_utc", F.timestamp_seconds("t"))


FEATURES = ["a", "b", "c", "d", "e"]  # d is a - b, e is constant


def standardized(df):
    rows = df.orderBy("t").toPandas()
    x, y = rows[FEATURES].to_numpy(), rows["y"].to_numpy()
    s = x.std(axis=0)
    s[s < 1e-12] = 1
    return (x - x.mean(axis=0)) / s, y - y.mean()


def test_moments_equal_numpy_and_add_up(spark):
    df = table(spark).withColumn("part", F.pmod(F.col("t") / 3600, F.lit(3)).cast("int")).cache()
    found = linear.moments(df, [*FEATURES, "y"], "part")
    whole = found[0] + found[1] + found[2]
    x = df.toPandas()[[*FEATURES, "y"]].to_numpy()
    assert whole.n == len(x)
    np.testing.assert_allclose(whole.mean, x.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(whole.products / whole.n, np.cov(x.T, bias=True), rtol=1e-6, atol=1e-6)
    with pytest.raises(ValueError):
        linear.sums(df, ["a"] * 102, [0.0] * 102, "part")


@pytest.mark.parametrize("profile", ["v1", "v2"])
def test_all_cells_are_optimal(spark, profile):
    df = table(spark, offset=10.0)
    grid = forecast.cells(**forecast.LINEAR_PROFILES[profile])
    found = linear.moments(df.withColumn("part", F.lit(0)), [*FEATURES, "y"], "part")[0]
    x, y = standardized(df)
    for cell, model in zip(grid, linear.solve([found], FEATURES, grid)[0]):
        w, l1, l2 = model.weights, cell["alpha"] * cell["l1_ratio"], cell["alpha"] * (1 - cell["l1_ratio"])
        slope = x.T @ (y - x @ w) / len(y) - l2 * w
        assert (np.abs(slope[w != 0] - l1 * np.sign(w[w != 0])) < 1e-6).all()
        assert (np.abs(slope[w == 0]) < l1 + 1e-6).all()
        assert w[4] == 0


def test_search_equals_fits_of_each_cell(spark):
    df = table(spark, offset=10.0).cache()
    grid = forecast.cells(alpha=[0.01, 0.3], l1_ratio=[0.5, 1.0])
    features = ["a", "b", "c"]
    model, cell, scores = linear.search(df, features, "y", grid, 2)
    _, same, fits = forecast.search(df, features, "y", forecast.elastic_net, grid, 2)
    assert cell == same
    got = {(r["cell"], r["fold"]): r["mae"] for r in scores.collect()}
    want = {(r["cell"], r["fold"]): r["mae"] for r in fits.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-3 for k in got)
    one = df.limit(1).withColumn("a", F.lit(None).cast("double"))
    assert model.transform(one).first()["prediction"] is None


def test_a_fold_is_scaled_by_its_own_training_rows(spark):
    df = table(spark, offset=0.0).cache()
    grid = [{"alpha": 0.5, "l1_ratio": 0.5}]
    late = F.row_number().over(Window.partitionBy("series_id").orderBy("t")) > 134
    far = df.withColumn("a", F.when(late, F.col("a") * 1000).otherwise(F.col("a")))
    first = lambda x: {r["fold"]: r["mae"] for r in linear.search(x, ["a", "b"], "y", grid, 2)[2].collect()}[0]
    assert abs(first(df) - first(far)) < 1e-9  # what comes after fold 0 is nothing to it


def test_search_refuses_what_it_cannot_judge(spark):
    df = table(spark)
    grid = [{"alpha": 1.0, "l1_ratio": 1.0}]
    with pytest.raises(ValueError, match="fewer"):
        linear.search(df.limit(50), ["a"], "y", grid)
    with pytest.raises(ValueError, match="twice"):
        linear.search(df.unionByName(df), ["a"], "y", grid)


def test_folds_are_scored_on_common_rows(spark):
    df = table(spark, n=600, offset=10.0)
    rows = df.withColumns({
        "fold": F.when(F.col("t") >= 1700000000 + 3600 * 400, 2).when(F.col("t") >= 1700000000 + 3600 * 300, 1), "hour_local": F.hour("timestamp_utc"),
        "a": F.when(F.col("t") / 3600 % 5 < 1, F.col("a")).otherwise(F.col("a") + 0.1), "lag": F.when(F.col("t") / 3600 % 3 < 2, F.col("y") + 1),
        "c": F.when(F.col("t") / 3600 % 7 >= 1, F.col("c")),
    })
    net = partial(linear.search, grid=forecast.cells(alpha=[0.01, 1.0], l1_ratio=[0.5]), k=2)
    found, chosen = linear.predict_folds(rows, "y", {"full": (net, ["a", "b", "c"]), "few": (net, ["b"])}, {"naive": "lag"}, [1, 2], ["series_id", "timestamp_utc", "hour_local"])
    assert all(sorted(c["feature"] for c in r["coefficients"]) == (["a", "b", "c"] if r["model"] == "full" else ["b"]) for r in chosen.collect())
    assert {(r["fold"], r["model"]) for r in chosen.collect()} == {(1, "full"), (1, "few"), (2, "full"), (2, "few")}
    held = found.toPandas()
    cover = {r["fold"]: r.asDict() for r in linear.fold_coverage(found, "y", ["naive", "full", "few"]).collect()}
    for fold, rows_of in held.groupby("fold"):
        common = rows_of.dropna(subset=["naive", "full", "few"])
        c = cover[fold]
        assert (c["n_rows"], c["n_full"], c["n_few"], c["n_common"]) == (len(rows_of), rows_of["full"].notna().sum(), len(rows_of), len(common))
    scores = linear.fold_scores(found, "y", ["naive", "full", "few"]).toPandas()
    one = scores[(scores.fold == 1) & (scores.model == "naive") & (scores.grouping_key == "overall")].iloc[0]
    assert one.n == cover[1]["n_common"] and abs(one.mae - 1) < 1e-9 and one.level is None
    hours = scores[(scores.fold == 1) & (scores.model == "full") & (scores.grouping_key == "hour")]
    assert hours.n.sum() == cover[1]["n_common"]
    assert set(scores[scores.grouping_key == "bucket"].level) <= {"negative", "above_200", "above_500"}
    train = df.where(f"t < {1700000000 + 3600 * 300}").toPandas()["y"]
    centre = train.median()
    limit = (train - centre).abs().quantile(0.95)
    first = held[held.fold == 1]
    assert (first.is_extreme == ((first.y - centre).abs() > limit)).all()
