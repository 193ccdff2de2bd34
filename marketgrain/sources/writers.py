"""Publishing tables, reports, exports and the relational copy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.operators.ranks import running_totals
from marketgrain.sources.schemas import FOREIGN_KEYS, RELATIONAL_NAMES, REQUIRED_COLUMNS

BATCH_ROWS = 10_000


def write_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Overwrite a parquet table and return it as read back, which cuts the plan behind it."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by_month(df: DataFrame, folder: str, name: str, month: str, key: str) -> DataFrame:
    """Overwrite a parquet table partitioned by month.

    Rows are spread by range of (month, key): a month that holds a large share of the rows goes to
    several tasks, and each file covers a narrow key range.
    """
    path = f"{folder}/{name}"
    df.repartitionByRange(month, key).write.mode("overwrite").partitionBy(month).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def write_csv(df: DataFrame, folder: str, name: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}", header=True, escape='"')


def export_csv(df: DataFrame, path: str) -> None:
    """A slice of any size as CSV, one file per task."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_report(row: DataFrame, folder: str, name: str) -> None:
    """A one-row result with nested fields as JSON; unknown values are written as null."""
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def nested_rows(df: DataFrame, name: str) -> DataFrame:
    """A table whose size the schema bounds (tables, findings) as one row holding an array of structs."""
    return df.agg(F.collect_list(F.struct(*df.columns)).alias(name))


def report_row(spark: SparkSession, parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row with a column per part; a part is a one-row table."""
    return spark.range(1).select(
        *[part.select(F.struct(*part.columns)).scalar().alias(name) for name, part in parts.items()]
    )


def relational_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Relational table name to its contracted columns in order."""
    return {target: tables[name].select(*REQUIRED_COLUMNS[name]) for name, target in RELATIONAL_NAMES.items()}


def load_order(tables: Iterable[str]) -> list[str]:
    """Tables with each parent of the declared foreign keys before its children."""
    left, placed = sorted(tables), []
    parents = {t: {parent for child, _, parent, _ in FOREIGN_KEYS if child == t and parent != t} for t in left}
    while left:
        ready = [t for t in left if parents[t] <= set(placed) or not parents[t] & set(left)]
        if not ready:
            raise ValueError(f"Foreign keys form a cycle among {left}")
        placed += ready
        left = [t for t in left if t not in ready]
    return placed


def staging_name(table: str) -> str:
    return f"{table}__staging"


def switch_statements(tables: Iterable[str]) -> list[str]:
    """The statements that exchange all tables for their staged copies; run in one transaction.

    Children are emptied before their parents and filled after them, so the foreign keys hold at every step.
    """
    order = load_order(tables)
    columns = {name: ", ".join(REQUIRED_COLUMNS[name]) for name in order}
    emptied = [f"DELETE FROM {RELATIONAL_NAMES[name]}" for name in reversed(order)]
    filled = []
    for name in order:
        target = RELATIONAL_NAMES[name]
        filled.append(f"INSERT INTO {target} ({columns[name]}) SELECT {columns[name]} FROM {staging_name(target)}")
    return emptied + filled


def load_relational(
    tables: Mapping[str, DataFrame],
    url: str,
    properties: Mapping[str, str],
    connect: Callable[[], Any] | None = None,
) -> None:
    """Empty and refill every relational table over JDBC, parents first.

    With ``connect``, which opens a connection of Python's database interface, all tables are first written to
    staging tables by the executors and then exchanged in one transaction: readers see all old or all new
    rows, and a failure leaves the old ones. Without it each table commits on its own.
    """
    loaded = relational_tables(tables)
    options = {**properties, "batchsize": str(BATCH_ROWS)}
    if connect is None:
        options |= {"truncate": "true", "cascadeTruncate": "true"}
        for name in load_order(RELATIONAL_NAMES):
            loaded[RELATIONAL_NAMES[name]].write.jdbc(url, RELATIONAL_NAMES[name], mode="overwrite", properties=options)
        return
    for target, rows in loaded.items():
        rows.write.jdbc(url, staging_name(target), mode="overwrite", properties=options)
    switch(connect(), RELATIONAL_NAMES)


def switch(connection: Any, tables: Iterable[str]) -> None:
    """Run ``switch_statements`` as one transaction; the staging tables go after it has committed."""
    try:
        cursor = connection.cursor()
        for statement in switch_statements(tables):
            cursor.execute(statement)
        connection.commit()
        for name in load_order(tables):
            cursor.execute(f"DROP TABLE {staging_name(RELATIONAL_NAMES[name])}")
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def with_row_keys(df: DataFrame, order: Sequence[str], name: str = "row_key") -> DataFrame:
    """Dense keys 1..n in a total order, without sorting the table into one task."""
    placed = running_totals(df.withColumn("__one", F.lit(1).cast("bigint")), order, ["__one"])
    return placed.select((F.col("__one_before") + 1).alias(name), *df.columns)
