"""A forest in parts: all trees vote, the driver holds few of them at once."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from marketgrain.ml import delivery, forest
from marketgrain.session import pin

ROWS, TREES, NODES = 800, 12, 60


@pytest.fixture(scope="module")
def rows(spark):
    generator = np.random.default_rng(8)
    x = generator.normal(size=(ROWS, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] + generator.normal(size=ROWS) > 0).astype(float)
    values = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(values, "id long, a double, b double, c double, d double, y double")
    return pin(frame.select("id", "y", array_to_vector(F.array("a", "b", "c", "d")).alias("features")))


@pytest.fixture(scope="module")
def estimator(spark):
    return RandomForestClassifier(labelCol="y", numTrees=TREES, maxDepth=6, minInstancesPerNode=20, seed=3)


@pytest.fixture(scope="module")
def parted(estimator, rows):
    return forest.grow(estimator, rows, ROWS, NODES)


def test_every_tree_is_grown_and_few_at_once(parted):
    parts = [RandomForestClassificationModel.load(path) for path in parted.paths]
    assert sum(part.getNumTrees for part in parts) == TREES and len(parts) > 2
    assert all(part.totalNumNodes <= 2 * NODES for part in parts)
    assert len({part.toDebugString.split("\n", 1)[1] for part in parts}) == len(parts)


def test_parts_vote_like_one_forest(parted, rows):
    got = parted.transform(rows).select("id", "y", "prediction", *[vector_to_array("probability")[k].alias(f"p{k}") for k in (0, 1)]).toPandas().sort_values("id")
    votes = np.zeros((ROWS, 2))
    for path in parted.paths:
        part = RandomForestClassificationModel.load(path).transform(rows).orderBy("id").select(vector_to_array("rawPrediction"))
        votes += np.array([r[0] for r in part.collect()])
    assert np.allclose(got[["p0", "p1"]].to_numpy(), votes / TREES) and len(got) == ROWS
    assert (got.prediction == (votes[:, 1] > votes[:, 0])).all() and (got.prediction == got.y).mean() > 0.7


def test_importances_are_the_mean_of_the_trees(parted):
    trees = [t.featureImportances.toArray() for p in parted.paths for t in RandomForestClassificationModel.load(p).trees]
    assert np.allclose(parted.featureImportances.toArray(), np.mean([t for t in trees if t.any()], axis=0))


def test_a_saved_forest_scores_alike(parted, rows, tmp_path):
    PipelineModel(stages=[parted]).write().overwrite().save(str(tmp_path / "forest"))
    loaded = PipelineModel.load(str(tmp_path / "forest"))
    a, b = ({r["id"]: r["probability"] for r in m.transform(rows).select("id", "probability").collect()} for m in (parted, loaded))
    assert a == b and len(a) == ROWS


def test_a_small_forest_stays_one_model(estimator, rows):
    one = forest.grow(estimator, rows, ROWS)
    assert isinstance(one, RandomForestClassificationModel) and one.getNumTrees == TREES


def test_the_order_table_is_read_once_for_training(small, monkeypatch):
    """Both the boundary and the rows come from one stored copy."""
    seen = []
    monkeypatch.setattr(delivery, "chronological_split", lambda rows: seen.append(rows._jdf.queryExecution().executedPlan().toString()) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        delivery.train(small.order_level)
    assert "FileScan" not in seen[0] and "Join" not in seen[0]


def test_delivery_trains_with_a_forest_in_parts(small, monkeypatch):
    monkeypatch.setattr(forest, "NODES", 400)
    settings = delivery.Settings(forest_trees=8, forest_depth=5, iterations=20, candidates=(delivery.FOREST,))
    result = delivery.train(small.order_level, settings)
    known = small.order_level.where("order_status = 'delivered' AND late_delivery IS NOT NULL")
    assert result.predictions.count() == result.predictions.select("order_id").distinct().count() == known.count()
    assert isinstance(result.model.stages[-1], forest.PartedForest) and result.importance.count() > 5
    assert result.predictions.where("late_delivery_probability NOT BETWEEN 0 AND 1 OR risk_category IS NULL").count() == 0


def test_the_forest_does_not_depend_on_the_place_of_rows(planted_orders):
    settings = delivery.Settings(forest_trees=4, forest_depth=4, candidates=(delivery.FOREST,))
    found = [delivery.train(rows, settings).predictions.orderBy("order_id").toPandas() for rows in planted_orders]
    assert len(found[0]) > 300 and (found[0].late_delivery_probability == found[1].late_delivery_probability).all()


@pytest.fixture(scope="module")
def planted_orders(small):
    rows = pin(small.order_level.where("order_status = 'delivered' AND late_delivery IS NOT NULL"))
    return rows.coalesce(1).orderBy("order_id"), rows.repartition(3, "customer_id").sortWithinPartitions(F.desc("order_id"))
