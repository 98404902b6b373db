"""Forecaster families on small series."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandloom.forecast import boosting, families, perseries, pooled, recursive, trees
from demandloom.forecast.pooled import PooledSettings
from demandloom.forecast.recursive import recursive_forecast
from demandloom.forecast.state import SeriesState, StatePlan
from demandloom.functions.dates import TradingCalendar
from demandloom.operators import features, metrics, series
from demandloom.session import materialise
from helpers import D, rows, series_frame

SMALL = PooledSettings(rounds=6, parallel=3, step=0.3, trees=5)
CALENDAR = TradingCalendar(event_date="2023-06-05")


@pytest.fixture(scope="module")
def weekly(spark):
    rng = np.random.default_rng(11)
    t = np.arange(150)
    season = 20 + 8 * np.sin(2 * np.pi * t / 52)
    values = {name: np.maximum(0, np.round(season * scale + rng.normal(size=150))) for name, scale in (("a", 1), ("b", 2), ("c", 0.5))}
    values["short"] = [5.0] * 40
    return materialise(series_frame(spark, values, start=D(2022, 1, 3)))


@pytest.fixture(scope="module")
def frame(weekly):
    return materialise(features.create_features(weekly, "weekly", CALENDAR))


@pytest.mark.parametrize("family", ["boosted", "forest", "arima", "additive", "tweedie", "linear"])
def test_holdout_forecasts(frame, family):
    found = families.train_and_predict(frame, family, settings=SMALL)
    assert found.count() == 3 * 13
    bad = found.where((F.col("Predicted") < 0) | (F.col("Predicted") != F.round("Predicted")) | F.col("Predicted").isNull())
    assert bad.isEmpty()


def test_families_beat_the_global_mean(frame):
    split = series.holdout_split(frame)
    mean = split.where("not is_test").agg(F.avg("Quantity_Sold")).first()[0]
    plain = split.where("is_test").withColumn("Predicted", F.round(F.lit(mean)))
    bar = metrics.forecast_metrics(plain).first()["wmape"]
    for family in families.FAMILIES:
        own = families.train_and_predict(frame, family, settings=SMALL)
        assert metrics.forecast_metrics(own).first()["wmape"] <= bar


def test_training_does_not_see_the_target(frame):
    clean = families.without_leaks(frame).where("Item = 'a'").orderBy("Date").collect()
    raw = frame.where("Item = 'a'").orderBy("Date").collect()
    assert [r["Diff_1"] for r in clean[1:]] == [r["Diff_1"] for r in raw[:-1]]


def test_save_and_load(spark, frame, weekly, tmp_path):
    for family in ("boosted", "forest", "arima"):
        bundle = families.train(frame, family, settings=SMALL)
        bundle.save(str(tmp_path / family))
        again = families.Bundle.load(spark, str(tmp_path / family))
        one = rows(families.generate_forecast(weekly, bundle, 2, CALENDAR), "Item", "Date")
        two = rows(families.generate_forecast(weekly, again, 2, CALENDAR), "Item", "Date")
        assert one == two and len(one) == 8
        assert (again.first_date, again.last_date) == ("2022-01-03", "2024-11-11")
        if family != "arima":
            assert [r["Item"] for r in again.item_models.select("Item").orderBy("Item").collect()] == ["a", "b", "c"]


def test_arima_falls_back_to_the_mean(frame, weekly):
    """No series here has the 200 weeks an ARIMA fit wants."""
    bundle = families.train(frame, "arima")
    assert bundle.item_models.count() == 0
    mean = weekly.agg(F.avg("Quantity_Sold")).first()[0]
    got = families.generate_forecast(weekly, bundle, 1, CALENDAR).collect()
    assert [r["Raw_Pred"] for r in got] == [pytest.approx(mean)] * 4


def test_arima_recovers_its_coefficients():
    rng = np.random.default_rng(3)
    d, e = np.zeros(3000), rng.normal(size=3000)
    for t in range(1, 3000):
        d[t] = 0.6 * d[t - 1] + e[t] + 0.3 * e[t - 1]
    phi, theta, _ = perseries.css_arima(100 + d.cumsum())
    assert phi == pytest.approx(0.6, abs=0.08) and theta == pytest.approx(0.3, abs=0.08)


def test_arima_path_is_the_geometric_sum(spark):
    models = spark.createDataFrame([("a", D(2025, 1, 6), 10.0, 0.5, 0.0, 4.0)],
                                   "Item string, last_date date, last_value double, phi double, theta double, next_step double")
    future = series_frame(spark, {"a": [0, 0, 0]}, start=D(2025, 1, 13))
    got = perseries.score_arima(future, models, 7).orderBy("Date").collect()
    assert [r["item_pred"] for r in got] == [14.0, 16.0, 17.0]


def test_additive_follows_trend_and_season(spark):
    t = np.arange(400)
    y = 50 + 0.1 * t + 10 * np.sin(2 * np.pi * t / 7)
    data = series_frame(spark, {"a": y}, start=D(2022, 1, 1), step=1)
    models = perseries.fit_additive(data.where(F.col("Date") < F.lit(D(2022, 12, 31))), 100)
    late = perseries.score_additive(data.where(F.col("Date") >= F.lit(D(2022, 12, 31))), models).toPandas()
    assert np.abs(late["item_pred"] - late["Quantity_Sold"]).mean() < 3


def test_recursive_forecast(spark):
    weekday = [10, 4, 4, 4, 8, 20, 18]
    data = series_frame(spark, {"a": weekday * 20, "tiny": [3] * 10, "gone": weekday * 10}, start=D(2024, 1, 1), step=1)
    got = recursive_forecast(data, 21, CALENDAR).toPandas()
    assert len(got) == 63 and (got["Predicted"] >= 0).all() and (got["Predicted"] % 1 == 0).all()
    mine = got[got["Item"] == "a"].sort_values("Date")
    assert mine["Date"].iloc[0] == D(2024, 1, 1) + dt.timedelta(days=140)
    assert mine["Predicted"].tolist()[:7] == pytest.approx(weekday, abs=4)
    assert got[got["Item"] == "tiny"]["Predicted"].max() <= 6


def test_cross_validation(frame):
    folds = (("2024-01-01", "2024-03-31"), ("2024-04-01", "2024-06-30"))
    clean = families.without_leaks(frame)
    rows_ = families.cv_rows(clean, folds)
    assert rows_.where("fold = 1 and is_test").agg(F.max("Date")).first()[0] <= D(2024, 3, 31)
    assert rows_.where("fold = 2 and not is_test").agg(F.max("Date")).first()[0] < D(2024, 4, 1)
    found = families.cross_validate(clean, folds, features.feature_columns("weekly"), "linear")
    assert {r["fold"] for r in families.cv_metrics(found).collect()} == {1, 2}
    peaks = clean.groupBy("Item").agg(F.max("Quantity_Sold").alias("m"))
    assert found.join(peaks, "Item").where(F.col("Predicted") > 2 * F.col("m")).isEmpty()


def test_comparison(frame):
    found, seconds = families.compare(frame, ["linear", "additive"], settings=SMALL)
    assert [r["model"] for r in found.collect()] == ["linear", "additive"] and seconds.count() == 2
    alone = metrics.forecast_metrics(families.train_and_predict(frame, "linear", settings=SMALL)).first()
    assert found.first()["wmape"] == pytest.approx(alone["wmape"])
    with pytest.raises(ValueError):
        families.compare(frame, ["linear", "nonsense"], settings=SMALL)


def test_boosting_keeps_many_trees_where_they_help(frame):
    settings = PooledSettings(rounds=40, parallel=5, step=0.1, boosted_min_rows=5, l1=0.0, l2=1.0)
    ready = families.without_leaks(frame)
    columns = features.feature_columns("weekly")
    model = pooled.fit_pooled(ready, columns, "boosted", settings)
    assert len(model.feature) > 10
    error = lambda m: pooled.score_pooled(m, ready).agg(F.avg(F.abs(F.col("pooled_pred") - F.col("Quantity_Sold")))).first()[0]
    assert error(model) < 0.8 * error(pooled.fit_pooled(ready, columns, "boosted", replace(settings, rounds=1, parallel=1)))


def test_patience():
    assert boosting.best_round([5, 4, 3, 3, 3, 3], 3) == 3 and boosting.best_round([5, 4, 3, 3, 3], 3) is None
    assert boosting.best_round([5, 6, 7, 8, 1], 3) == 1 and boosting.best_round([], 3) is None


@pytest.fixture(scope="module")
def counts(spark):
    """Skewed quantities with many zeros, whose mean depends on two columns."""
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(1200, 2)).round(3)
    mean = np.exp(1.5 * x[:, 0] + (x[:, 1] > 0.5))
    y = np.array([rng.gamma(1.0, m, size=n).sum() for m, n in zip(mean, rng.poisson(1.0, 1200))]).round(3)
    return materialise(spark.createDataFrame(
        [(float(a), float(b), float(q), i % 5 == 0) for i, ((a, b), q) in enumerate(zip(x, y))],
        "a double, b double, Quantity_Sold double, is_val boolean"))


def test_two_boosting_rounds_equal_a_recomputation(counts):
    """Leaf values by the formulas, row by row, from the splits that the trees took."""
    settings = PooledSettings(rounds=2, parallel=1, step=0.3, sample=1.0, l1=2.0, l2=3.0)
    found = boosting.fit(counts, ["a", "b"], settings)
    rows_ = counts.where("not is_val").collect()
    x, y = np.array([[r["a"], r["b"]] for r in rows_]), np.array([r["Quantity_Sold"] for r in rows_])
    raw = np.full(len(y), np.log(y.mean()))
    assert found.base == pytest.approx(raw[0])
    for t in range(2):
        leaf = found.leaves(x)[:, t]
        g = np.exp(0.5 * raw) - y * np.exp(-0.5 * raw)
        h = 0.5 * (np.exp(0.5 * raw) + y * np.exp(-0.5 * raw))
        for k in range(8):
            total = g[leaf == k].sum()
            step = -np.sign(total) * max(abs(total) - 2.0, 0.0) / (h[leaf == k].sum() + 3.0)
            assert found.value[t, k] == pytest.approx(0.3 * step)
        # The first cut is the best one of the working response, of those between the bins.
        if t == 0:
            z = -g / h
            gain = lambda side: (h[side] * z[side]).sum() ** 2 / h[side].sum()
            own = x[:, found.feature[t, 0]] <= found.threshold[t, 0]
            for column in range(2):
                for cut in np.quantile(x[:, column], np.linspace(0.1, 0.9, 9)):
                    side = x[:, column] <= cut
                    assert gain(own) + gain(~own) >= 0.99 * (gain(side) + gain(~side))
        raw = raw + found.value[t, leaf]
    assert trees.score(counts, found).where("not is_val").count() == len(y)
    assert found.predict(x) == pytest.approx(np.exp(raw))


def test_tweedie_boosting_beats_squared_boosting(counts):
    """On held-out Tweedie data, in deviance."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    found = boosting.fit(counts, ["a", "b"], PooledSettings(rounds=40, parallel=4, step=0.1, l1=0.0, l2=1.0))
    core, held = counts.where("not is_val"), counts.where("is_val")
    put = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform
    squared = GBTRegressor(labelCol="Quantity_Sold", predictionCol="Predicted", maxIter=40, stepSize=0.1, maxDepth=3, seed=1).fit(put(core))
    plain = squared.transform(put(held)).withColumn("Predicted", F.greatest("Predicted", F.lit(0.01)))
    assert boosting.deviance(trees.score(held, found, "Predicted")) < boosting.deviance(plain)


def test_trees_of_one_round_share_their_scores(counts):
    """Four trees, two at a time: the second pair sees the first's scores, a pair the same ones."""
    settings = PooledSettings(rounds=4, parallel=2, step=0.3, sample=0.7, l1=2.0, l2=3.0)
    found = boosting.fit(counts.withColumn("is_val", F.lit(False)), ["a", "b"], settings)
    rows_ = counts.collect()
    x, y = np.array([[r["a"], r["b"]] for r in rows_]), np.array([r["Quantity_Sold"] for r in rows_])
    leaves, raw = found.leaves(x), np.full(len(y), found.base)
    assert len(found.value) == 4
    for pair in ((0, 1), (2, 3)):
        g, h = trees.gradients(raw, y, True)
        for t in pair:
            sums = [np.bincount(leaves[:, t], v, 8) for v in (g, h)]
            assert found.value[t] == pytest.approx(0.3 * trees.newton_step(*sums, 2.0, 3.0))
            raw = raw + found.value[t, leaves[:, t]]


def test_boosting_ends_at_the_best_held_out_deviance(counts):
    """Held-out rows of another kind: no tree helps, one is left; without them all trees stay."""
    odd = counts.withColumn("Quantity_Sold", F.when(F.col("is_val"), 30.0 * (F.col("b") < 0.5).cast("double")).otherwise(F.col("Quantity_Sold")))
    settings = PooledSettings(rounds=12, parallel=2, step=0.4, patience=2, l1=0.0, l2=1.0)
    assert len(boosting.fit(odd, ["a", "b"], settings).value) < 12
    assert len(boosting.fit(counts.where("not is_val"), ["a", "b"], settings).value) == 12


def test_negative_quantities_and_rows_without_a_validation_part(spark):
    data = spark.createDataFrame([(float(i % 7), float(i % 5) - 1.0, False) for i in range(100)], "a double, Quantity_Sold double, is_val boolean")
    found = boosting.fit(data, ["a"], PooledSettings(rounds=3, step=0.3, l1=0.0))
    assert len(found.feature) == 3 and np.isfinite(found.value).all()
    with pytest.raises(ValueError):
        boosting.fit(data.where("false"), ["a"], SMALL)


def test_parsed_forest_predicts_like_mllib(frame):
    ready = families.without_leaks(frame)
    columns = features.feature_columns("weekly")
    model = pooled.fit_pooled(ready, columns, "forest", SMALL)
    numbers = pooled.as_numbers(model, columns)
    rows_ = pooled.score_pooled(model, ready).toPandas()
    assert numbers.predict(rows_[columns].to_numpy(float)) == pytest.approx(rows_["pooled_pred"].to_numpy())
    for kind in ("linear", "tweedie"):
        model = pooled.fit_pooled(ready, columns, kind, SMALL)
        rows_ = pooled.score_pooled(model, ready).toPandas()
        assert pooled.as_numbers(model, columns).predict(rows_[columns].to_numpy(float)) == pytest.approx(rows_["pooled_pred"].to_numpy())


def test_item_leaves_equal_a_recomputation(frame):
    """Each leaf of each tree: a Newton step over the item's rows in it, a share of one tree."""
    ready = families.without_leaks(frame)
    columns = features.feature_columns("weekly")
    model = pooled.fit_pooled(ready, columns, "boosted", replace(SMALL, l1=0.0))
    own = {r["Item"]: np.array(r["added"]).reshape(model.value.shape) for r in trees.fit_item_leaves(ready, model, 100, 1.0, 4.0).collect()}
    assert set(own) == {"a", "b", "c"}
    rows_ = ready.toPandas()
    for item, added in own.items():
        mine = rows_[rows_["Item"] == item]
        x, y = mine[columns].to_numpy(float), mine["Quantity_Sold"].to_numpy(float)
        leaf, raw = model.leaves(x), np.log(model.predict(x))
        for t in range(len(model.feature)):
            for k in range(8):
                side = leaf[:, t] == k
                g = (np.exp(0.5 * raw[side]) - y[side] * np.exp(-0.5 * raw[side])).sum()
                h = 0.5 * (np.exp(0.5 * raw[side]) + y[side] * np.exp(-0.5 * raw[side])).sum()
                step = -np.sign(g) * max(abs(g) - 1.0, 0.0) / (h + 4.0) if side.any() else 0.0
                assert added[t, k] == pytest.approx(step / len(model.feature))
    scored = trees.score_item_leaves(ready, trees.fit_item_leaves(ready, model, 100, 0.0, 1.0), model).toPandas()
    assert scored[scored["Item"] == "short"]["item_pred"].isna().all()
    held = scored[scored["Item"] == "c"]
    miss = lambda name: (held[name] - held["Quantity_Sold"]).abs().mean()
    assert miss("item_pred") < miss("pooled_pred")


def test_forecasts_feed_the_next_step(spark, frame):
    """A forecaster that adds one to the last known week counts on: 7, 8, 9 and not 7, 1, 1."""
    data = materialise(series_frame(spark, {"a": [2.0] * 20 + [6.0], "b": [1.0] * 21}, start=D(2024, 1, 1)))
    bundle = families.train(frame, "linear")

    def counting(name):
        weights = np.array([float(c == name) for c in bundle.columns])
        model = replace(bundle, pooled=pooled.Linear(1.0, weights), item_models=bundle.item_models.limit(0))
        found = families.generate_forecast(data, model, 3, CALENDAR).orderBy("Item", "Date").collect()
        return [r["Predicted"] for r in found]

    assert counting("Lag_1") == [7.0, 8.0, 9.0, 2.0, 3.0, 4.0]
    # The difference before each week, plus one: 6 - 2, then the forecasts' own steps, below zero cut off.
    assert counting("Diff_1") == [5.0, 0.0, 0.0, 1.0, 1.0, 1.0]


def test_generated_forecast_equals_step_by_step_features(frame, weekly):
    """The walk inside an item gives what recomputing the frame before every week gives.

    The event is not yet: a frame counts the coming week's zero as a week after it.
    """
    calm = TradingCalendar(event_date="2035-01-01")
    for family in ("boosted", "forest", "linear"):
        bundle = families.train(frame, family, settings=SMALL)
        got = families.generate_forecast(weekly, bundle, 3, calm).toPandas().sort_values(["Item", "Date"])
        known = weekly.select("Item", "Date", "Quantity_Sold")
        for _ in range(3):
            step = families.predict(
                features.future_features(known, 1, "weekly", calm, finish=families.without_leaks, periods=1), bundle, leak_free=True)
            known = materialise(known.unionByName(step.select("Item", "Date", F.col("Predicted").alias("Quantity_Sold"))))
        last = weekly.agg(F.max("Date")).first()[0]
        want = known.where(F.col("Date") > F.lit(last)).toPandas().sort_values(["Item", "Date"])
        assert list(got["Date"]) == list(want["Date"]) and list(got["Predicted"]) == list(want["Quantity_Sold"])


@pytest.mark.parametrize("frequency", ["weekly", "daily"])
def test_state_equals_the_feature_frame(spark, frequency):
    """On known history, column by column, for the model's frame and the exploratory one."""
    rng = np.random.default_rng(8)
    step = 7 if frequency == "weekly" else 1
    data = materialise(series_frame(
        spark, {"hot": rng.integers(0, 30, 90).astype(float), "cold": rng.integers(0, 5, 50).astype(float), "new": [3.0]},
        start=D(2023, 4, 3), step=step))
    plan = features.PLANS[frequency]
    frames = {
        "model": (families.without_leaks(features.create_features(data, frequency, CALENDAR)), (plan.short, plan.long, 10.0)),
        "exploratory": (families.without_leaks(features.exploratory_features(data, frequency, CALENDAR, "hot", clip=False)), (4, 8, 5.0))}
    for made, trend in frames.values():
        rows_ = made.toPandas().sort_values(["Item", "Date"])
        state_plan = StatePlan.of(made.columns, CALENDAR.event_date, trend=trend, surge_item="hot")
        assert len(state_plan.names) >= 9
        for item, mine in rows_.groupby("Item"):
            values = mine["Quantity_Sold"].to_numpy(float)
            before = (mine["Date"] < D(2023, 6, 5)).to_numpy()
            sums = (values[before].sum(), before.sum(), values[~before].sum(), (~before).sum())
            state = SeriesState(state_plan, item, event_sums=sums)
            for (_, row), value in zip(mine.iterrows(), values):
                assert state.features(row["Date"]) == pytest.approx(row[list(state_plan.names)].to_numpy(float), abs=1e-9), (item, row["Date"])
                state.push(row["Date"], value)


def test_a_step_of_the_state_does_not_depend_on_the_history():
    plan = StatePlan.of(["Lag_1", "EWMA_7", "Roll_Q95_7", "Recent_vs_Old_Trend"], "2023-06-05", trend=(7, 28, 10.0))
    state = SeriesState(plan, "a")
    for k in range(3000):
        state.push(D(2020, 1, 1) + dt.timedelta(days=k), float(k % 10))
    assert len(state.ring) == plan.reach == 35 and state.features(D(2030, 1, 1))[0] == 9.0


def test_recursive_uses_all_features(spark):
    data = series_frame(spark, {"a": [10, 4, 4, 4, 8, 20, 18] * 12}, start=D(2024, 1, 1), step=1)
    made = recursive.daily_frame(data, CALENDAR, "a")
    wanted = {"Lag_14", "Roll_Mean_14", "EWMA_7", "Diff_7", "Item_Surge", "Rebrand_Surge", "Payday_Weekend", "Days_Since_Start"}
    assert wanted <= set(made.columns)


def test_first_served_week_knows_the_last_difference(spark):
    """A history that ends 30, 4: the first future period has the difference -26, not 0."""
    data = materialise(series_frame(spark, {"a": [10.0] * 30 + [30.0, 4.0]}, start=D(2024, 1, 1)))
    served = features.future_features(data, 2, "weekly", CALENDAR, finish=families.without_leaks).orderBy("Date").collect()
    assert [r["Diff_1"] for r in served] == [-26.0, -4.0]


def test_overfit_verdict(frame):
    row = families.overfit_check(frame, "linear", settings=SMALL).first()
    assert row["verdict"] in ("acceptable", "moderate", "significant")
    assert row["gap_r2"] == pytest.approx(row["test_r2"] - row["train_r2"], abs=1e-3)
