"""A random forest grown in parts, so that the driver never holds more than a bounded number of tree nodes.

Spark keeps all trees of one fit as objects of the driver, some hundred bytes a node, and the nodes of deep trees grow
with the rows. A part is one fit of so many trees as stay below a number of nodes; it is saved and let go before the
next one is grown, and scoring reads one part after another. The trees are the same in number, depth and leaf size, and
every one of them votes.
"""

from __future__ import annotations

import uuid
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.operators.quality import union_all
from marketgrain.session import checkpoint_folder, pin

# Fixed value: nodes of all trees that are grown at once; each takes the driver about 400 bytes while it grows.
NODES = 250_000
#: Between the seeds of two parts, above any number of partitions that draw their rows from neighbouring seeds.
_SEED_STEP = 100_003


def most_nodes(estimator: RandomForestClassifier, rows: int) -> int:
    """What a tree over ``rows`` can't exceed, by its depth and by the rows of a leaf."""
    leaves = max(1, rows // estimator.getMinInstancesPerNode())
    return min(2 ** (estimator.getMaxDepth() + 1), 2 * leaves)


def _read(estimator: RandomForestClassifier) -> list[str]:
    weight = [estimator.getWeightCol()] if estimator.isDefined("weightCol") else []
    return [estimator.getLabelCol(), *weight]


def grow(estimator: RandomForestClassifier, df: DataFrame, rows: int, nodes: int | None = None) -> Model:
    """The fitted forest: one Spark model if it is certain to stay below ``nodes``, else a ``PartedForest``.

    The first part is as small as the rows could require, the following ones go by the trees grown so far. At most the
    part that grows and the one before it, which is being saved, are held at once.
    """
    nodes, trees, spark = nodes or NODES, estimator.getNumTrees(), df.sparkSession
    # a task for each core: every task holds counts for all nodes that are split at once
    cores = max(1, spark.sparkContext.defaultParallelism)
    size = max(1, nodes // most_nodes(estimator, rows))
    if size >= trees:
        return estimator.fit(df.coalesce(cores))
    df = pin(df.select(estimator.getFeaturesCol(), *_read(estimator)).repartition(cores))
    folder, grown, held, paths = f"{checkpoint_folder(spark)}/forest-{uuid.uuid4()}", 0, 0, []
    importances = np.zeros(0)
    with ThreadPool(1) as saver:
        saved = None
        while grown < trees:
            size = min(size, trees - grown)
            part = estimator.fit(df, {estimator.numTrees: size, estimator.seed: estimator.getSeed() + _SEED_STEP * grown})
            if saved:
                saved.get()
            paths.append(f"{folder}/{len(paths)}")
            # written while the next part grows
            saved = saver.apply_async(inheritable_thread_target(spark)(part.write().save), (paths[-1],))
            # Spark's figure of a forest is the mean over the trees that split at all
            split = sum(tree.numNodes > 1 for tree in part.trees)
            of_part = split * part.featureImportances.toArray()
            importances = of_part if not grown else importances + of_part
            grown, held = grown + size, held + part.totalNumNodes
            size = max(1, int(nodes * grown / held))
            del part
        saved.get()
    total = importances.sum() or 1.0
    model = PartedForest(paths=paths, parts=len(paths), importances=[float(x) for x in importances / total])
    columns = ("featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol")
    return model._set(**{c: estimator.getOrDefault(c) for c in columns})


class _Writer(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        for k, part in enumerate(self.instance.paths):
            RandomForestClassificationModel.load(part).write().save(f"{path}/part-{k}")


class _Reader(DefaultParamsReader):
    def load(self, path: str) -> PartedForest:
        model = super().load(path)
        model.paths = [f"{path}/part-{k}" for k in range(model.getOrDefault(model.parts))]
        return model


class PartedForest(
    Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, MLWritable, MLReadable
):
    """The saved parts of one forest; adds the columns that Spark's own model adds.

    The votes of each part are written before the next part is read, so ``transform`` runs jobs.
    """

    parts = Param(Params._dummy(), "parts", "number of saved parts", TypeConverters.toInt)
    importances = Param(Params._dummy(), "importances", "mean importance per feature", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, paths=(), parts=0, importances=()):
        super().__init__()
        self.paths = list(paths)
        self._set(parts=parts, importances=list(importances))

    @property
    def featureImportances(self) -> DenseVector:
        return Vectors.dense(self.getOrDefault(self.importances))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = pin(dataset.withColumn("__row", F.monotonically_increasing_id()))
        # trees look features up by number, which takes a search in a sparse vector
        dense = rows.select("__row", array_to_vector(vector_to_array(self.getFeaturesCol())).alias(self.getFeaturesCol()))
        votes = [
            pin(self._part(path).transform(dense).select("__row", F.lit(k).alias("part"), vector_to_array("__votes").alias("votes")))
            for k, path in enumerate(self.paths)
        ]
        every = union_all(votes).groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("part", "votes"))).alias("all"))
        listed = [F.col("all")[k]["votes"] for k in range(len(self.paths))]
        added = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), listed)
        whole = F.aggregate("__sums", F.lit(0.0), lambda a, x: a + x)
        shares = F.transform("__sums", lambda x: x / whole)
        raw, probability, chosen = self.getRawPredictionCol(), self.getProbabilityCol(), self.getPredictionCol()
        summed = every.select("__row", added.alias("__sums")).select(
            "__row",
            array_to_vector("__sums").alias(raw),
            array_to_vector(shares).alias(probability),
            (F.array_position("__sums", F.array_max("__sums")) - 1).cast("double").alias(chosen),
        )
        return rows.join(summed, "__row").drop("__row")

    def _part(self, path: str) -> RandomForestClassificationModel:
        part = RandomForestClassificationModel.load(path)
        part.setFeaturesCol(self.getFeaturesCol())
        return part.setRawPredictionCol("__votes").setProbabilityCol("").setPredictionCol("")

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader(cls)
