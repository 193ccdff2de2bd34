import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from marketgrain.ml import delivery, levels, prep, retention, segmentation
from marketgrain.ml import metrics as measures


def brute_auc(y, p):
    positive, negative = p[y == 1], p[y == 0]
    wins = (positive[:, None] > negative[None, :]).sum() + 0.5 * (positive[:, None] == negative[None, :]).sum()
    return wins / (len(positive) * len(negative))


def brute_average_precision(y, p):
    total, before = 0.0, 0
    for threshold in sorted(set(p), reverse=True):
        chosen = p >= threshold
        hits = y[chosen].sum()
        total += (hits - before) / y.sum() * hits / chosen.sum()
        before = hits
    return total


@pytest.fixture(scope="module")
def scored(spark):
    generator = np.random.default_rng(5)
    y = generator.integers(0, 2, 400)
    # a third of all rows share one score
    p = np.where(generator.random(400) < 0.33, 0.5, np.round((generator.random(400) + 0.4 * y) / 1.4, 2))
    return y, p, spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))


def test_classification_metrics_equal_brute_force(scored):
    y, p, df = scored
    row = measures.classification_metrics(df, "y", "p").first()
    hit = p >= 0.5
    precision, recall = y[hit].mean(), hit[y == 1].mean()
    assert row["accuracy"] == pytest.approx((hit == (y == 1)).mean())
    assert (row["precision"], row["recall"]) == (pytest.approx(precision), pytest.approx(recall))
    assert row["f1"] == pytest.approx(2 * precision * recall / (precision + recall))
    assert row["roc_auc"] == pytest.approx(brute_auc(y, p))
    assert row["pr_auc"] == pytest.approx(brute_average_precision(y, p))


def test_metrics_of_several_models_at_once(scored):
    y, p, df = scored
    both = df.select(F.lit("a").alias("model"), "y", "p").union(df.select(F.lit("b"), "y", 1 - F.col("p")))
    rows = {r["model"]: r for r in measures.classification_metrics(both, "y", "p", ["model"]).collect()}
    assert rows["a"]["roc_auc"] == pytest.approx(brute_auc(y, p))
    assert rows["b"]["roc_auc"] == pytest.approx(1 - brute_auc(y, p))


def test_single_class_has_no_area(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.9)], "y int, p double")
    row = measures.classification_metrics(df, "y", "p").first()
    assert (row["precision"], row["recall"], row["f1"], row["roc_auc"]) == (0.0, 0.0, 0.0, None)


def test_curves_are_monotone_and_closed(scored):
    y, p, df = scored
    roc = measures.roc_curve(df, "y", "p").toPandas().sort_values("threshold", ascending=False)
    assert (roc.iloc[0].false_positive_rate, roc.iloc[0].true_positive_rate) == (0, 0)
    assert (roc.iloc[-1].false_positive_rate, roc.iloc[-1].true_positive_rate) == (1, 1)
    assert roc.true_positive_rate.is_monotonic_increasing and len(roc) == len(set(p)) + 1
    pr = measures.pr_curve(df, "y", "p").toPandas()
    assert ((pr.precision == 1) & (pr.recall == 0) & pr.threshold.isna()).sum() == 1


def test_chronological_split_is_positional(spark):
    days = [datetime.datetime(2018, 1, 1)] * 6 + [datetime.datetime(2018, 1, 2)] * 4
    rows = [(f"o{i}", day) for i, day in enumerate(days)]
    frame = spark.createDataFrame(rows, "order_id string, order_purchase_timestamp timestamp_ntz")
    for share in (0.8, 0.5):
        split = delivery.chronological_split(frame, share)
        training = {r["order_id"] for r in split.where("evaluation_split = 'Training'").collect()}
        assert training == {f"o{i}" for i in range(int(share * 10))}


def test_risk_bands(spark):
    from marketgrain.functions.scalars import risk_band

    frame = spark.createDataFrame([(0.25,), (0.2501,), (0.5,), (0.51,), (None,)], "p double")
    assert [r[0] for r in frame.select(risk_band(F.col("p"))).collect()] == ["Low", "Medium", "Medium", "High", None]


@pytest.fixture(scope="module")
def planted(spark):
    """Orders whose lateness follows the promise and the seller's state."""
    generator = np.random.default_rng(11)
    n = 1500
    promise = generator.uniform(5, 40, n)
    seller = generator.choice(["SP", "RJ", "BA"], n)
    chance = 1 / (1 + np.exp(0.25 * (promise - 15) - 1.5 * (seller == "BA")))
    frame = pd.DataFrame(
        {
            "order_id": [f"o{i:05d}" for i in range(n)],
            "order_purchase_timestamp": pd.date_range("2018-01-01", periods=n, freq="h"),
            "order_status": "delivered",
            "customer_state": generator.choice(["SP", "RJ", "XX"], n, p=[0.6, 0.395, 0.005]),
            "seller_state": seller,
            "product_category": generator.choice(["Art", "Toys"], n),
            "dominant_payment_type": "credit_card",
            "estimated_delivery_days": promise,
            "late_delivery": (generator.random(n) < chance).astype("int32"),
        }
    )
    for name in delivery.NUMERIC:
        if name not in frame:
            frame[name] = generator.random(n)
    frame.loc[::50, "distance_km"] = np.nan
    schema = spark.createDataFrame(frame.head(1)).schema
    df = spark.createDataFrame(frame, schema)
    return df.withColumn("order_purchase_timestamp", F.col("order_purchase_timestamp").cast("timestamp_ntz")).withColumn(
        "distance_km", F.when(~F.isnan("distance_km"), F.col("distance_km"))
    )


@pytest.fixture(scope="module")
def trained(planted):
    return delivery.train(planted, delivery.Settings(forest_trees=10, forest_depth=6))


def test_delivery_models_find_the_signal(trained):
    rows = {r["model"]: r for r in trained.metrics.collect()}
    assert set(rows) == {delivery.BASELINE, delivery.LOGISTIC, delivery.TREE, delivery.FOREST}
    assert rows[delivery.BASELINE]["roc_auc"] == 0.5
    assert all(rows[m]["roc_auc"] > 0.7 for m in (delivery.LOGISTIC, delivery.TREE, delivery.FOREST))
    chosen = [m for m, r in rows.items() if r["selected"]]
    assert chosen == [trained.selected] and chosen[0] != delivery.BASELINE


def test_delivery_scores_cover_every_order(trained, planted):
    scores = trained.predictions.toPandas()
    assert len(scores) == planted.count() and scores.late_delivery_probability.between(0, 1).all()
    assert (scores.evaluation_split == "Training").sum() == int(0.8 * len(scores))
    matrix = trained.confusion.toPandas().set_index("actual")
    assert matrix.to_numpy().sum() == len(scores) - int(0.8 * len(scores))
    names = [r["feature"] for r in trained.importance.collect()]
    assert "numeric__estimated_delivery_days" in names[:3] or "categorical__seller_state_BA" in names[:3]
    plain = [r["feature"] for r in delivery.readable_importance(trained.importance).collect()]
    assert any(name in ("Estimated Delivery Days", "Seller State Ba") for name in plain)


def test_saved_model_scores_new_orders_alike(trained, planted, tmp_path):
    path = str(tmp_path / "model")
    trained.model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    raw = planted.drop("late_delivery", "gross_order_value").withColumn(
        "customer_state", F.when(F.col("order_id") == "o00001", "never seen").otherwise(F.col("customer_state"))
    )
    a = delivery.score(trained.model, raw).orderBy("order_id").toPandas().late_delivery_probability
    b = delivery.score(loaded, raw).orderBy("order_id").toPandas().late_delivery_probability
    assert np.array_equal(a, b) and a.between(0, 1).all()


def test_preparation_groups_rare_levels_and_ignores_unseen(spark):
    rows = [("a", 1.0)] * 30 + [("b", 3.0)] * 25 + [("c", None)] * 3 + [(None, 2.0)] * 2
    train = spark.createDataFrame(rows, "k string, n double")
    fitted = prep.fit_preparation(train, ["n"], ["k"])
    new = spark.createDataFrame([("c", None), ("zzz", 2.0), (None, 2.0), ("it's", 1.0)], "k string, n double")
    out = fitted.transform(new).collect()
    by_level = {r["k"]: r for r in out}
    assert {k: r["n__number"] for k, r in by_level.items()} == {"c": 1.0, "zzz": 2.0, None: 2.0, "it's": 1.0}
    assert {k: r["k__level"] for k, r in by_level.items()} == {"c": prep.RARE, "zzz": "zzz", None: "a", "it's": "it's"}
    assert by_level["zzz"]["k__onehot"].numNonzeros() == 0 and by_level["c"]["k__onehot"].numNonzeros() == 1


def test_level_table_holds_any_number_of_levels_and_survives_saving(spark, tmp_path):
    rows = [(f"rare {k}", "x") for k in range(3000)] + [("usual", None)] * 30 + [(None, "y")] * 19
    train = spark.createDataFrame(rows, "k string, j string")
    model = levels.LevelTable(inputCols=["k", "j"], outputCols=["k2", "j2"]).fit(train)
    assert model.table.where("level IS NOT NULL").count() == 3001
    new = spark.createDataFrame([("rare 7", "y"), ("usual", "x"), (None, None), ("new", "z"), ("it's", "y")], "k string, j string")
    want = {("rare 7", "infrequent", "infrequent"), ("usual", "usual", "x"), (None, "usual", "x"), ("new", "new", "z"), ("it's", "it's", "infrequent")}
    assert {(r["k"], r["k2"], r["j2"]) for r in model.transform(new).collect()} == want
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "levels"))
    loaded = PipelineModel.load(str(tmp_path / "levels"))
    assert {(r["k"], r["k2"], r["j2"]) for r in loaded.transform(new).collect()} == want


def test_levels_of_a_small_or_empty_column(spark):
    train = spark.createDataFrame([("a", None)] * 3, "k string, j string")
    model = levels.LevelTable(inputCols=["k", "j"], outputCols=["k2", "j2"], minimum=5).fit(train)
    rows = model.transform(spark.createDataFrame([("a", None), (None, "q")], "k string, j string")).collect()
    assert {(r["k2"], r["j2"]) for r in rows} == {("infrequent", None), ("infrequent", "q")}


def test_silhouettes_equal_brute_force(spark):
    generator = np.random.default_rng(2)
    points = generator.normal(size=(60, 3)) + 3 * (np.arange(60) % 3)[:, None]
    marks = {"three": np.arange(60) % 3, "single": np.where(np.arange(60) == 0, 1, 0), "one": np.zeros(60, int)}
    rows = [(*map(float, p), *(int(m[i]) for m in marks.values())) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, ["x", "y", "z", *marks])
    row = segmentation.silhouettes(frame, ["x", "y", "z"], list(marks)).first()

    def brute(marks):
        distance = ((points[:, None] - points[None]) ** 2).sum(2)
        widths = []
        for i in range(len(points)):
            own = (marks == marks[i]) & (np.arange(len(points)) != i)
            others = [distance[i, marks == m].mean() for m in set(marks) if m != marks[i]]
            if not own.any() or not others:
                widths.append(0.0)
                continue
            inside, nearest = distance[i, own].mean(), min(others)
            widths.append((nearest - inside) / max(nearest, inside))
        return np.mean(widths)

    assert row.asDict() == {name: pytest.approx(brute(m)) for name, m in marks.items()}


def test_segments_separate_planted_groups(spark):
    generator = np.random.default_rng(4)
    rows = []
    for i in range(300):
        good = i % 3 == 0
        rows.append((i, int(i % 10 != 9), int(generator.integers(1, 30) if good else generator.integers(300, 400)),
                     int(generator.integers(8, 12) if good else 1), float(generator.uniform(900, 1100) if good else 20)))
    frame = spark.createDataFrame(rows, "customer_unique_id long, delivered_orders int, recency int, frequency int, monetary double")
    result = segmentation.train(frame, cluster_counts=(2, 3), restarts=2)
    assert result.metadata["selected_k"] == 2
    segments = result.segments.toPandas()
    assert len(segments) == 300
    assert (segments[segments.delivered_orders == 0].segment == segmentation.UNSEGMENTED).all()
    bought = segments[segments.delivered_orders > 0]
    assert (bought[bought.monetary > 500].segment == "High Value").all()
    assert (bought[bought.monetary < 500].segment == "Low Engagement").all()
    counts = {r["segment"]: r["customers"] for r in segmentation.segment_counts(result.segments).collect()}
    assert sum(counts.values()) == 300 and counts[segmentation.UNSEGMENTED] == 30
    means = {r["segment"]: r["monetary"] for r in segmentation.segment_means(result.segments).collect()}
    assert means["High Value"] > means["Low Engagement"]
    assert segmentation.largest_segment(result.profiles).first()["segment"] == "Low Engagement"
    assert {r["segment"] for r in segmentation.interpretations(result.profiles).collect()} == {"High Value", "Low Engagement"}


def test_rfm_leaves_out_customers_without_delivery(spark):
    frame = spark.createDataFrame(
        [("a", 1, 1, 10.0, 1), ("b", 2, 0, 0.0, 0)],
        "customer_unique_id string, recency int, frequency int, monetary double, delivered_orders int",
    )
    assert [r[0] for r in segmentation.rfm_base(frame).collect()] == ["a"]


def test_retention_split_keeps_class_shares(spark):
    frame = spark.range(400).selectExpr("id AS customer_unique_id", "CAST(id % 10 = 0 AS INT) AS target")
    split = retention.stratified_split(frame).toPandas()
    counts = split.groupby(["target", "split"]).size()
    assert counts[(1, "Training")] == 30 and counts[(0, "Training")] == 270 and len(split) == 400


def test_closed_gate_explains_itself(small):
    result = retention.train(
        small.orders("customers", "sums", "reviews"), datetime.datetime(2000, 12, 31), datetime.datetime(2001, 6, 30)
    )
    assert not result.metadata["model_trained"] and result.model is None
    assert "too sparse" in result.metrics.first()["reason"]
    assert result.predictions.where("future_purchase_probability IS NOT NULL").count() == 0


def test_retention_window_is_inclusive(spark):
    def at(text):
        return datetime.datetime.fromisoformat(text)

    rows = [
        ("1", "in", at("2018-02-28T23:59:59")), ("2", "in", at("2018-03-01")),
        ("3", "late", at("2018-01-01")), ("4", "late", at("2018-08-31T23:59:59")),
        ("5", "out", at("2018-01-01")), ("6", "out", at("2018-09-01")),
        ("7", "new", at("2018-05-01")),
    ]
    frame = spark.createDataFrame(rows, "order_id string, customer_unique_id string, order_purchase_timestamp timestamp_ntz").selectExpr(
        "*", "'delivered' AS order_status", "CAST(10 AS DECIMAL(12,2)) AS merchandise_revenue", "1 AS item_count",
        "CAST(1 AS DECIMAL(12,2)) AS total_freight_value", "5.0D AS average_review_score", "0 AS late_delivery",
    )
    got = {r["customer_unique_id"]: r for r in retention.retention_dataset(frame).collect()}
    assert {k: r["target"] for k, r in got.items()} == {"in": 1, "late": 1, "out": 0}
    assert got["in"]["recency_at_cutoff"] == 0 and got["late"]["recency_at_cutoff"] == 59
