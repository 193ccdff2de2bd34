import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketgrain.plans import forecast

SERIES = "series"


def months(spark, orders, revenue=None, start=(2016, 1)):
    rows = []
    for i, count in enumerate(orders):
        year, month = start[0] + (start[1] - 1 + i) // 12, (start[1] - 1 + i) % 12 + 1
        rows.append(("all", datetime.datetime(year, month, 1), count, float((revenue or orders)[i])))
    return spark.createDataFrame(
        rows, "series string, purchase_period timestamp_ntz, all_orders long, merchandise_revenue double"
    )


def complete_by_hand(counts):
    i = len(counts) - 1
    while i >= 6:
        if counts[i] >= max(50, 0.25 * float(np.median(counts[i - 6 : i]))):
            break
        i -= 1
    return i + 1


@pytest.mark.parametrize(
    "counts",
    [
        [100] * 6,
        [100] * 7,
        [100] * 6 + [3],
        [100] * 8 + [10, 2],
        [400] * 7 + [99],
        [400] * 7 + [100],
        [1, 2, 3],
        [10] * 12,
        [100] * 8 + [10] + [100],
    ],
)
def test_complete_months(spark, counts):
    flagged = forecast.complete_months(months(spark, counts), SERIES).orderBy("purchase_period").collect()
    assert sum(r["is_complete"] for r in flagged) == complete_by_hand(counts)
    assert [r["is_complete"] for r in flagged] == sorted((r["is_complete"] for r in flagged), reverse=True)


def by_hand(values, held_out, horizon):
    """Walk-forward and recursive naive forecasts."""

    def guess(name, history):
        if name == forecast.LAST_VALUE:
            return history[-1]
        if name == forecast.MOVING_AVERAGE:
            return float(np.mean(history[-3:]))
        return history[-12] if len(history) >= 12 else history[-1]

    walked, future = {}, {}
    for name in forecast.CANDIDATES[:3]:
        history = list(values[:-held_out])
        for actual in values[-held_out:]:
            walked.setdefault(name, []).append(guess(name, history))
            history.append(actual)
        history = list(values)
        for _ in range(horizon):
            history.append(guess(name, history))
        future[name] = history[-horizon:]
    return walked, future


@pytest.mark.parametrize("n", [7, 11, 14, 22])
def test_naive_forecasts(spark, n):
    revenue = [float(v) for v in np.random.default_rng(n).integers(100, 900, n)]
    split = forecast.split_months(forecast.complete_months(months(spark, [100] * n, revenue), SERIES), SERIES)
    held_out = min(4, max(3, n // 5))
    walked, future = by_hand(revenue, held_out, 6)
    got = forecast.naive_predictions(split, SERIES).orderBy("model", "purchase_period").collect()
    for name, values in walked.items():
        assert [r["predicted"] for r in got if r["model"] == name] == pytest.approx(values)
    ahead = forecast.naive_future(split, SERIES).orderBy("model", "step").collect()
    for name, values in future.items():
        assert [r["predicted"] for r in ahead if r["model"] == name] == pytest.approx(values)


def test_trend_finds_a_planted_line(spark):
    n = 24
    revenue = [1000 + 10 * i + 50 * np.sin(2 * np.pi * (i % 12 + 1) / 12) for i in range(n)]
    split = forecast.split_months(forecast.complete_months(months(spark, [100] * n, revenue), SERIES), SERIES)
    rows = forecast.trend_predictions(split, SERIES).collect()
    future = sorted((r["step"], r["predicted"]) for r in rows if r["phase"] == "Future")
    want = [1000 + 10 * i + 50 * np.sin(2 * np.pi * (i % 12 + 1) / 12) for i in range(n, n + 6)]
    assert [p for _, p in future] == pytest.approx(want)
    assert sum(r["phase"] == "Validation" for r in rows) == 4


def test_history_selects_the_best_model_and_labels_rows(spark):
    n = 24
    revenue = [1000.0 + 10 * i for i in range(n)] + [5.0]
    history = forecast.forecast_history(months(spark, [100] * n + [2], revenue), SERIES).collect()
    labels = [r["split"] for r in history]
    assert {s: labels.count(s) for s in set(labels)} == {
        "Training": 20,
        "Validation": 4,
        "Excluded Partial": 1,
        "Future Forecast": 6,
    }
    validated = [r for r in history if r["split"] == "Validation"]
    assert all(r["predicted"] == pytest.approx(r["actual"]) for r in validated)
    future = sorted((r["purchase_period"], r["future_forecast"]) for r in history if r["split"] == "Future Forecast")
    assert future[0][0] == datetime.datetime(2018, 1, 1)
    assert future[0][1] == pytest.approx(1240.0)


def test_metrics_skip_zero_actuals(spark):
    rows = [("m", 0.0, 5.0), ("m", 10.0, 5.0)]
    row = forecast.forecast_metrics(spark.createDataFrame(rows, "model string, actual double, predicted double"), ["model"]).first()
    assert (row["mae"], row["rmse"], row["mape"]) == (5.0, 5.0, 0.5)


def least_squares(values, calendar, horizon):
    """The trend by a general solver: held-out months, then the months after the last."""

    def solve(index, month, target, later_index, later_month):
        def design(i, m):
            angle = 2 * np.pi * np.asarray(m) / 12
            return np.column_stack([i, np.sin(angle), np.cos(angle)])

        known, asked = design(index, month), design(later_index, later_month)
        centre = known.mean(axis=0)
        weights = np.linalg.lstsq(known - centre, target - target.mean(), rcond=1e-7)[0]
        return np.maximum((asked - centre) @ weights + target.mean(), 0.0)

    n, target, index = len(values), np.array(values), np.arange(len(values) + horizon)
    train = max(0, n - min(4, max(3, n // 5)))
    counted = index % 12 + 1
    held_out = solve(index[:train], counted[:train], target[:train], index[train:n], counted[train:n]) if train else []
    following = (calendar[-1] + np.arange(horizon)) % 12 + 1
    return list(held_out), list(solve(index[:n], calendar, target, index[n:], following))


@pytest.mark.parametrize(("n", "start"), [(1, 5), (2, 1), (3, 6), (4, 3), (5, 12), (6, 2), (7, 7), (9, 1), (30, 4), (61, 11)])
def test_trend_equals_a_general_solver(spark, n, start):
    """Short histories take the weights of least length."""
    revenue = [float(v) for v in np.random.default_rng(n).integers(100, 900, n)]
    split = forecast.split_months(
        forecast.complete_months(months(spark, [100] * n, revenue, (2016, start)), SERIES), SERIES
    )
    complete = split.orderBy("purchase_period").collect()
    calendar = np.array([r["purchase_period"].month for r in complete])
    held_out, ahead = least_squares(revenue[: len(complete)], calendar, 6)
    rows = forecast.trend_predictions(split, SERIES).collect()
    found = {(r["phase"], r["step"]): r["predicted"] for r in rows}
    assert [found["Future", k] for k in range(1, 7)] == pytest.approx(ahead, abs=1e-6)
    assert [found["Validation", k + 1] for k in range(len(held_out))] == pytest.approx(held_out, abs=1e-6)
    assert len(found) == 6 + len(held_out)


def test_trend_on_one_calendar_month_a_year(spark):
    rows = [("all", datetime.datetime(2010 + k, 6, 1), 100, 100.0 + 7 * k) for k in range(6)]
    schema = "series string, purchase_period timestamp_ntz, all_orders long, merchandise_revenue double"
    split = forecast.split_months(forecast.complete_months(spark.createDataFrame(rows, schema), SERIES), SERIES)
    future = [r["predicted"] for r in forecast.trend_predictions(split, SERIES).orderBy("step").collect() if r["phase"] == "Future"]
    want = least_squares([100.0 + 7 * k for k in range(6)], np.array([6] * 6), 6)[1]
    assert future == pytest.approx(want, abs=1e-6)


def test_history_equals_its_parts(spark):
    """One plan for all rows gives what the single steps give, for several series of different length."""
    frames = []
    for k, n in enumerate((3, 7, 13, 26, 40)):
        revenue = [float(v) for v in np.random.default_rng(k).integers(100, 900, n)]
        frames.append(months(spark, [100] * n + [1], [*revenue, 3.0]).withColumn("series", F.lit(f"s{k}")))
    monthly = frames[0]
    for frame in frames[1:]:
        monthly = monthly.unionByName(frame)
    history = forecast.forecast_history(monthly, SERIES).collect()
    flagged = forecast.complete_months(monthly, SERIES).cache()
    split = forecast.split_months(flagged, SERIES)
    predictions = forecast.validation_predictions(split, SERIES)
    chosen = {r["series"]: r["model"] for r in forecast.compare_models(predictions, SERIES).where("selected").collect()}
    want = {(r["series"], r["purchase_period"]): r["predicted"] for r in predictions.collect() if chosen[r["series"]] == r["model"]}
    got = {(r["series"], r["purchase_period"]): r["predicted"] for r in history if r["split"] == "Validation"}
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: v for k, v in got.items() if v is not None}
    ahead = forecast.future_predictions(split, SERIES).collect()
    want = {(r["series"], r["purchase_period"]): r["predicted"] for r in ahead if chosen[r["series"]] == r["model"]}
    got = {(r["series"], r["purchase_period"]): r["future_forecast"] for r in history if r["split"] == "Future Forecast"}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert sum(r["split"] == "Excluded Partial" for r in history) == flagged.where("NOT is_complete").count()
    assert len(history) == monthly.count() + 6 * len(frames)
