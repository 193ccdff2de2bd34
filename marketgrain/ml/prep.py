"""Feature preparation as persistable Spark ML stages, fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.ml.levels import RARE, LevelTable
from marketgrain.operators.ranks import exact_quantiles

def numeric_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The exact median of every column: one number per feature comes back."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    found = {r["column"]: r["quantile"] for r in exact_quantiles(long, "value", [0.5], ["column"]).collect()}
    return {c: found.get(c, 0.0) for c in columns}


def imputer(train: DataFrame, numeric: Sequence[str]) -> SQLTransformer:
    """Numeric nulls become the median, written as a SQL stage that is saved with the pipeline."""
    columns = [f"COALESCE(CAST(`{c}` AS DOUBLE), {m!r}D) AS `{c}__number`" for c, m in numeric_medians(train, numeric).items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")


def level_names(categorical: Sequence[str]) -> list[str]:
    return [f"{c}__level" for c in categorical]


def level_stage(categorical: Sequence[str]) -> LevelTable:
    """Text nulls become the most frequent level, rare levels one level."""
    return LevelTable(inputCols=list(categorical), outputCols=level_names(categorical))


def imputed(train: DataFrame, rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``rows`` with the ``__number`` and ``__level`` columns that scaling and encoding start from."""
    numbers = imputer(train, numeric).transform(rows)
    return level_stage(categorical).fit(train).transform(numbers) if categorical else numbers


def fit_preparation(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> PipelineModel:
    """Impute, scale the numbers, one-hot the levels; a level unseen in training becomes all zeros."""
    levels, indexes = level_names(categorical), [f"{c}__index" for c in categorical]
    encoded = [f"{c}__onehot" for c in categorical]
    stages: list = [
        imputer(train, numeric),
        VectorAssembler(inputCols=[f"{c}__number" for c in numeric], outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
    ]
    if categorical:
        stages += [
            level_stage(categorical),
            StringIndexer(inputCols=levels, outputCols=indexes, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexes, outputCols=encoded, dropLast=True, handleInvalid="error"),
        ]
    stages.append(VectorAssembler(inputCols=["scaled", *encoded], outputCol="features"))
    return Pipeline(stages=stages).fit(train)


def feature_names(prepared: DataFrame, numeric: Sequence[str], column: str = "features") -> list[str]:
    """Names of the vector's slots: numeric__<column> and categorical__<column>_<level>."""
    slots = prepared.schema[column].metadata["ml_attr"]["attrs"]
    by_index = {a["idx"]: a.get("name", str(a["idx"])) for kind in slots.values() for a in kind}
    names = []
    for index in range(len(by_index)):
        name = by_index[index]
        if name.startswith("scaled_"):
            names.append(f"numeric__{numeric[int(name.rsplit('_', 1)[1])]}")
        else:
            column_name, level = name.split("__onehot_", 1)
            names.append(f"categorical__{column_name}_{level}")
    return names


def joined_model(*parts: PipelineModel | Transformer) -> PipelineModel:
    """Fitted parts as one model that scores raw feature rows."""
    stages: list = []
    for part in parts:
        stages += part.stages if isinstance(part, PipelineModel) else [part]
    return PipelineModel(stages=stages)
