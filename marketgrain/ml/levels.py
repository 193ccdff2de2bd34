"""A fitted stage that keeps a column's rare levels in a table and looks them up by a join.

Levels that occur seldom in training share one name, and a missing level takes the most frequent one. The table is
a DataFrame from the fit to the saved model: no list of levels passes through the driver or a plan, however many a
column has, and adaptive execution chooses how each lookup is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLWritable,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.session import pin

RARE = "infrequent"
# Fixed value: levels seen fewer times than this in training share one column.
MINIMUM_FREQUENCY = 20


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, level, n`` of every level that occurs."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    known = text.unpivot([], list(columns), "column", "level").where(F.col("level").isNotNull())
    return known.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


def level_table(counts: DataFrame, minimum: int = MINIMUM_FREQUENCY) -> DataFrame:
    """``column, level, mapped``: the rare levels, and under the null level what stands for a missing value."""
    rare = counts.where(F.col("n") < minimum).select("column", "level", F.lit(RARE).alias("mapped"))
    usual = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("below"), "level")).alias("first"))
    missing = usual.select(
        "column",
        F.lit(None).cast("string").alias("level"),
        F.when(-F.col("first.below") < minimum, RARE).otherwise(F.col("first.level")).alias("mapped"),
    )
    return rare.unionByName(missing)


class _LevelParams(HasInputCols, HasOutputCols):
    minimum = Param(Params._dummy(), "minimum", "occurrences from which a level is kept", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(minimum=MINIMUM_FREQUENCY)


class LevelTable(Estimator, _LevelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the table of rare levels of ``inputCols``."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, minimum=MINIMUM_FREQUENCY):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LevelTableModel:
        counts = level_counts(dataset, self.getInputCols())
        # read once per column and scoring: written, and cut off from the training rows
        model = LevelTableModel(pin(level_table(counts, self.getOrDefault(self.minimum))))
        return self._copyValues(model)


class _TableWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(DefaultParamsReader):
    def load(self, path: str) -> LevelTableModel:
        model = super().load(path)
        model.table = SparkSession.active().read.schema("column string, level string, mapped string").parquet(f"{path}/table")
        return model


class LevelTableModel(Model, _LevelParams, MLWritable, MLReadable):
    """Adds each output column: the level, its shared name if it is rare, the usual one if it is missing.

    A level that training didn't see stays as it is.
    """

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table = table

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for source, target in zip(self.getInputCols(), self.getOutputCols()):
            known = self.table.where(F.col("column") == source).select(F.col("level").alias("__level"), F.col("mapped").alias("__mapped"))
            level = F.col(source).cast("string")
            joined = dataset.join(known, level.eqNullSafe(F.col("__level")), "left")
            dataset = joined.withColumn(target, F.coalesce("__mapped", level)).drop("__level", "__mapped")
        return dataset

    def write(self) -> _TableWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> _TableReader:
        return _TableReader(cls)
