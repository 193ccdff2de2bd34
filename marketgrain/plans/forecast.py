"""Monthly sales forecasts for any number of series.

Input is monthly sales with a series key: at most one row per series and calendar month, so windows
per series stay small however many orders the months sum up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from marketgrain.plans import trend

LAST_VALUE = "Last Value Naive"
MOVING_AVERAGE = "Moving Average (3)"
SEASONAL = "Seasonal Naive"
TREND = "Linear Trend + Seasonality"
CANDIDATES = (LAST_VALUE, MOVING_AVERAGE, SEASONAL, TREND)

# A month is complete from 50 orders and a quarter of the median of the six before it.
MINIMUM_ORDERS = 50
MEDIAN_SHARE = 0.25
SEASON = 12
HORIZON = 6


def complete_months(monthly: DataFrame, series: str, minimum_orders: int = MINIMUM_ORDERS) -> DataFrame:
    """``monthly`` with position, ``is_complete`` and the series' last complete month ``cutoff``.

    The cut is the latest row, from the seventh on, whose order count reaches the minimum; without
    one it is the sixth row. Positions are rows: missing months are not filled.
    """
    by_month = Window.partitionBy(series).orderBy("purchase_period")
    whole = Window.partitionBy(series)
    usual = F.expr("percentile(all_orders, 0.5)").over(by_month.rowsBetween(-6, -1))
    enough = (F.col("position") >= 6) & (
        F.col("all_orders") >= F.greatest(F.lit(float(minimum_orders)), F.col("usual") * MEDIAN_SHARE)
    )
    return (
        monthly.withColumn("position", F.row_number().over(by_month) - 1)
        .withColumn("usual", usual)
        .withColumn("rows", F.count(F.lit(1)).over(whole))
        .withColumn(
            "last_position",
            F.coalesce(
                F.max(F.when(enough, F.col("position"))).over(whole), F.least(F.col("rows") - 1, F.lit(5))
            ).cast("int"),
        )
        .withColumn("is_complete", F.col("position") <= F.col("last_position"))
        .withColumn("cutoff", F.max(F.when(F.col("is_complete"), F.col("purchase_period"))).over(whole))
        .drop("usual", "rows", "last_position")
    )


def split_months(months: DataFrame, series: str) -> DataFrame:
    """Complete months only, labelled Training or Validation: the last min(4, max(3, n // 5)) validate."""
    n = F.count(F.lit(1)).over(Window.partitionBy(series))
    held_out = F.least(F.lit(4), F.greatest(F.lit(3), F.floor(n / 5)))
    return (
        months.where("is_complete")
        .withColumn("months", n)
        .withColumn("split", F.when(F.col("position") >= F.col("months") - held_out, "Validation").otherwise("Training"))
    )


def _naive_guesses(value: Column, window: WindowSpec) -> dict[str, Column]:
    last = F.lag(value, 1).over(window)
    return {
        LAST_VALUE: last,
        MOVING_AVERAGE: F.avg(value).over(window.rowsBetween(-3, -1)),
        SEASONAL: F.coalesce(F.lag(value, SEASON).over(window), last),
    }


def naive_predictions(months: DataFrame, series: str) -> DataFrame:
    """Walk-forward predictions of the three naive candidates on the validation months.

    Actuals are fed back, so each is a window over the rows before the predicted one.
    """
    value = F.col("merchandise_revenue").cast("double")
    guesses = _naive_guesses(value, Window.partitionBy(series).orderBy("purchase_period"))
    wide = months.select(
        series,
        "purchase_period",
        "split",
        value.alias("actual"),
        *[guess.alias(name) for name, guess in guesses.items()],
    ).where(F.col("split") == "Validation")
    return wide.unpivot([series, "purchase_period", "actual"], list(guesses), "model", "predicted")


def _trend_fits(months: DataFrame, series: str) -> DataFrame:
    """One row per series: ``validation`` fitted on the training months, ``future`` on all complete months.

    Validation counts seasons from the first row, Future takes real calendar months. Both fits come from one
    aggregate; ``validation`` is null without a training month.
    """
    phases = F.array(
        F.struct(
            F.lit("validation").alias("phase"),
            (F.col("position") % SEASON + 1).alias("month"),
            (F.col("split") == "Training").alias("known"),
        ),
        F.struct(F.lit("future").alias("phase"), F.month("purchase_period").alias("month"), F.lit(True).alias("known")),
    )
    points = months.select(
        series, F.col("position").cast("bigint").alias("x"), F.col("merchandise_revenue").alias("y"), F.explode(phases).alias("p")
    ).where("p.known")
    fitted = trend.fits(points.select(series, "p.phase", "p.month", "x", "y"), [series, "phase"])
    fit = F.struct(*trend.FIT)
    return fitted.groupBy(series).agg(
        *[F.max(F.when(F.col("phase") == phase, fit)).alias(phase) for phase in ("validation", "future")]
    )


def _at_row(fit: str) -> Column:
    """The validation fit at the row's own position."""
    return trend.predicted(F.col(fit), F.col("position"), F.col("position") % SEASON + 1)


def _ahead(fit: str, rows: Column, cutoff: Column, step: Column) -> Column:
    """The future fit ``step`` months after the last of ``rows`` complete months."""
    return trend.predicted(F.col(fit), rows + step - 1, F.month(F.add_months(cutoff.cast("date"), step)))


def trend_predictions(months: DataFrame, series: str, horizon: int = HORIZON) -> DataFrame:
    """Least squares on row index and yearly sine and cosine, clipped at zero.

    Rows (series, phase, step, predicted): the steps of Validation are the held-out months, those of Future the
    months after the last complete one.
    """
    counts = months.groupBy(series).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("split") == "Training").alias("position"),
        F.max("purchase_period").alias("cutoff"),
    )
    both = counts.join(_trend_fits(months, series), series)
    held_out = both.where("position > 0").select(
        series, "validation", "position", F.explode(F.sequence(F.lit(1), (F.col("rows") - F.col("position")).cast("int"))).alias("step")
    )
    held_out = held_out.withColumn("position", F.col("position") + F.col("step") - 1)
    ahead = both.select(series, "future", "rows", "cutoff", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return held_out.select(series, F.lit("Validation").alias("phase"), "step", _at_row("validation").alias("predicted")).unionByName(
        ahead.select(
            series, F.lit("Future").alias("phase"), "step", _ahead("future", F.col("rows"), F.col("cutoff"), F.col("step")).alias("predicted")
        )
    )


def validation_predictions(months: DataFrame, series: str, candidates: Sequence[str] = CANDIDATES) -> DataFrame:
    """Rows (series, purchase_period, actual, model, predicted) of all candidates."""
    naive = naive_predictions(months, series).where(F.col("model").isin(*candidates))
    if TREND not in candidates:
        return naive
    by_month = Window.partitionBy(series).orderBy("purchase_period")
    held_out = months.where(F.col("split") == "Validation").select(
        series,
        "purchase_period",
        F.col("merchandise_revenue").cast("double").alias("actual"),
        F.row_number().over(by_month).alias("step"),
    )
    line = trend_predictions(months, series).where(F.col("phase") == "Validation")
    joined = held_out.join(line, [series, "step"]).select(
        series, "purchase_period", "actual", F.lit(TREND).alias("model"), "predicted"
    )
    return naive.unionByName(joined)


def forecast_metrics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MAE, RMSE and MAPE (a fraction; zero actuals are skipped) per group of predictions."""
    error = F.col("actual") - F.col("predicted")
    share = F.when(F.col("actual") != 0, F.abs(error) / F.abs(F.col("actual")))
    return predictions.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(share).alias("mape")
    )


def _candidate_order(model: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CANDIDATES]), model)


def compare_models(predictions: DataFrame, series: str) -> DataFrame:
    """Metrics per series and model; ``selected`` marks the least RMSE (the earlier candidate on ties)."""
    metrics = forecast_metrics(predictions, [series, "model"])
    best = F.row_number().over(Window.partitionBy(series).orderBy(F.asc_nulls_last("rmse"), _candidate_order(F.col("model"))))
    return metrics.withColumn("selected", best == 1)


def forecast_facts(months: DataFrame, metrics: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """One row on a single series: how many months trained and validated, the last complete one, the selected model."""
    chosen = metrics.where("selected").agg(F.max(F.struct("model", "rmse"))).scalar()
    return months.agg(
        F.count_if(F.col("split") == "Training").alias("training_months"),
        F.count_if(F.col("split") == "Validation").alias("validation_months"),
        F.min("purchase_period").alias("first_month"),
        F.max("purchase_period").alias("last_complete_month"),
    ).select("*", F.lit(horizon).alias("forecast_months"), chosen.getField("model").alias("selected_model"), chosen.getField("rmse").alias("validation_rmse"))


def _naive_ahead(tail: Column, horizon: int) -> dict[str, Column]:
    """The next ``horizon`` values of each naive candidate after ``tail``, the last values of a series.

    Predictions are fed back: the recursion folds over the tail.
    """

    def last(history: Column) -> Column:
        return F.element_at(history, -1)

    def mean_of_three(history: Column) -> Column:
        recent = F.slice(history, F.greatest(F.size(history) - 2, F.lit(1)), F.lit(3))
        return F.aggregate(recent, F.lit(0.0), lambda total, v: total + v) / F.size(recent)

    def season_ago(history: Column) -> Column:
        return F.when(F.size(history) >= SEASON, F.try_element_at(history, F.lit(-SEASON))).otherwise(last(history))

    def ahead(rule) -> Column:
        whole = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), tail, lambda history, _: F.concat(history, F.array(rule(history))))
        return F.slice(whole, F.size(tail) + 1, F.lit(horizon))

    return {name: ahead(rule) for name, rule in ((LAST_VALUE, last), (MOVING_AVERAGE, mean_of_three), (SEASONAL, season_ago))}


def naive_future(months: DataFrame, series: str, horizon: int = HORIZON) -> DataFrame:
    """Recursive forecasts (series, purchase_period, model, step, predicted) of the naive candidates."""
    position = F.col("position")
    last_rows = months.withColumn("from_end", F.col("months") - position).where(F.col("from_end") <= SEASON)
    tails = last_rows.groupBy(series).agg(
        F.array_sort(F.collect_list(F.struct(position, F.col("merchandise_revenue").cast("double").alias("v")))).alias(
            "tail"
        ),
        F.max("purchase_period").alias("cutoff"),
    )
    tails = tails.withColumn("tail", F.transform("tail", lambda row: row.getField("v")))
    candidates = F.array(
        *[F.struct(F.lit(name).alias("model"), values.alias("values")) for name, values in _naive_ahead(F.col("tail"), horizon).items()]
    )
    every = tails.select(series, "cutoff", F.explode(candidates).alias("candidate")).select(
        series, "cutoff", "candidate.model", F.posexplode("candidate.values").alias("ahead", "predicted")
    )
    step = F.col("ahead") + 1
    return every.select(
        series, _months_after(F.col("cutoff"), step).alias("purchase_period"), "model", step.alias("step"), "predicted"
    )


def _months_after(month: Column, count: Column) -> Column:
    return F.add_months(month.cast("date"), count).cast("timestamp_ntz")


def future_predictions(months: DataFrame, series: str, horizon: int = HORIZON) -> DataFrame:
    """Forecasts of all four candidates."""
    cutoffs = months.groupBy(series).agg(F.max("purchase_period").alias("cutoff"))
    line = (
        trend_predictions(months, series, horizon)
        .where(F.col("phase") == "Future")
        .join(cutoffs, series)
        .select(
            series,
            _months_after(F.col("cutoff"), F.col("step")).alias("purchase_period"),
            F.lit(TREND).alias("model"),
            "step",
            "predicted",
        )
    )
    return naive_future(months, series, horizon).unionByName(line)


def forecast_history(
    monthly: DataFrame, series: str, minimum_orders: int = MINIMUM_ORDERS, horizon: int = HORIZON
) -> DataFrame:
    """Training, validation, excluded and future rows of every series under its selected model.

    One plan without a job of its own: the months are dealt by series once, and every step below is a window or a
    group of that series. The last complete month carries the future rows until they are listed.
    """
    flagged = complete_months(monthly, series, minimum_orders)
    whole = Window.partitionBy(series)
    amount = F.col("merchandise_revenue").cast("double")
    rows = F.count_if(F.col("is_complete"))
    held_out = F.least(F.lit(4), F.greatest(F.lit(3), F.floor(F.col("months") / 5)))
    validated = F.col("position") >= F.col("months") - held_out
    labelled = flagged.withColumn("months", rows.over(whole)).withColumn(
        "split",
        F.when(~F.col("is_complete"), "Excluded Partial").when(validated, "Validation").otherwise("Training"),
    )
    # complete months are the first rows of a series, so the rows before one are complete too
    window = whole.orderBy("purchase_period")
    guessed = labelled.withColumns({f"guess_{k}": guess for k, guess in enumerate(_naive_guesses(amount, window).values())})
    tail = F.collect_list(amount).over(window.rowsBetween(1 - SEASON, 0))
    guessed = guessed.withColumn("tail", F.when(F.col("position") == F.col("months") - 1, tail))
    fitted = guessed.join(_trend_fits(labelled.where("is_complete"), series), series)
    place = CANDIDATES.index(TREND)
    fitted = fitted.withColumn(f"guess_{place}", F.when(F.col("validation").isNotNull(), _at_row("validation")))

    def error(k: int) -> Column:
        missed = amount - F.col(f"guess_{k}")
        return F.sqrt(F.avg(F.when(F.col("split") == "Validation", missed * missed)).over(whole))

    # least error first, unknown errors last, the earlier candidate on ties
    ranked = [F.struct(error(k).isNull().alias("unknown"), error(k).alias("rmse"), F.lit(k).alias("k")) for k in range(len(CANDIDATES))]
    chosen = fitted.withColumn("chosen", F.array_min(F.array(*ranked)).getField("k"))
    guesses = F.array(*[F.col(f"guess_{k}") for k in range(len(CANDIDATES))])
    naive = _naive_ahead(F.col("tail"), horizon)
    steps = F.sequence(F.lit(1), F.lit(horizon))
    ahead = [naive[name] if name in naive else F.transform(steps, lambda step: _ahead("future", F.col("months"), F.col("purchase_period"), step)) for name in CANDIDATES]
    following = F.element_at(F.array(*ahead), F.col("chosen") + 1)

    nothing = F.lit(None).cast("double")

    def row(period: Column, actual: Column, guess: Column, future: Column, split: Column) -> Column:
        return F.struct(
            period.alias("purchase_period"), actual.alias("actual"), guess.alias("predicted"), future.alias("future_forecast"), split.alias("split")
        )

    guess = F.when(F.col("split") == "Validation", F.element_at(guesses, F.col("chosen") + 1))
    own = row(F.col("purchase_period"), amount, guess, nothing, F.col("split"))
    later = F.transform(
        following,
        lambda value, k: row(_months_after(F.col("purchase_period"), k + 1), nothing, nothing, value, F.lit("Future Forecast")),
    )
    listed = F.when(F.col("tail").isNotNull(), F.concat(F.array(own), later)).otherwise(F.array(own))
    return chosen.select(series, F.explode(listed).alias("row")).select(series, "row.*")


def mark_complete(monthly: DataFrame, minimum_orders: int = MINIMUM_ORDERS) -> DataFrame:
    """Monthly sales of one marketplace with ``is_complete``."""
    columns = monthly.columns
    single = monthly.withColumn("__series", F.lit("all"))
    return complete_months(single, "__series", minimum_orders).select(*columns, "is_complete")
