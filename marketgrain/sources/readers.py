"""Reading source files and published results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marketgrain.sources.lazy import LazyTables
from marketgrain.sources.schemas import SCHEMAS

#: Tables whose quoted texts hold line breaks.
MULTILINE_TABLES = frozenset({"reviews"})


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the path's own file system, be it local, HDFS or an object store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def source_paths(spark: SparkSession, folder: str, files: Mapping[str, str] | None = None) -> dict[str, str]:
    """Path per source table; all missing ones are named in one error. ``files`` maps table to file name."""
    names = {table: f"{table}.csv" for table in SCHEMAS} | dict(files or {})
    paths = {table: f"{folder.rstrip('/')}/{name}" for table, name in names.items()}
    missing = [path for path in paths.values() if not path_exists(spark, path)]
    if missing:
        raise FileNotFoundError("Missing source files:\n" + "\n".join(missing))
    return paths


def file_columns(spark: SparkSession, path: str) -> list[str]:
    """The column names in the header of a CSV file or folder."""
    return spark.read.csv(path, header=True, escape='"').columns


def contract_order(header: Sequence[str], ddl: str) -> tuple[T.StructType, list[str]]:
    """The types of a file's columns in the file's own order, and the contract's columns in its order."""
    contract = {field.name: field.dataType for field in T.StructType.fromDDL(ddl).fields}
    fields = [T.StructField(name, contract.get(name, T.StringType())) for name in header]
    return T.StructType(fields), list(contract)


def read_sources(spark: SparkSession, folder: str, files: Mapping[str, str] | None = None) -> LazyTables:
    """The nine CSV tables under their source column names, with declared types and dates as text.

    Columns are found by the header, in any order; all missing ones are named in one error and others are
    ignored. A value that does not fit its type fails the read. Only reviews hold line breaks in quotes, so
    only they are read as whole files; ``store_sources`` keeps a columnar copy to work from.
    """
    paths = source_paths(spark, folder, files)
    headers = {table: file_columns(spark, path) for table, path in paths.items()}
    orders = {table: contract_order(headers[table], SCHEMAS[table]) for table in paths}
    gaps = {t: sorted(set(names) - set(headers[t])) for t, (_, names) in orders.items()}
    if any(gaps.values()):
        raise ValueError("Missing source columns: " + "; ".join(f"{t}: {', '.join(g)}" for t, g in gaps.items() if g))

    def reader(table: str):
        schema, names = orders[table]
        options = {"header": True, "escape": '"', "mode": "FAILFAST", "multiLine": table in MULTILINE_TABLES}
        return lambda: spark.read.schema(schema).csv(paths[table], **options).select(*names)

    return LazyTables({table: reader(table) for table in SCHEMAS})


def store_sources(tables: Mapping[str, DataFrame], folder: str) -> LazyTables:
    """Write every table once as parquet and return the tables read from there."""
    for table in tables:
        tables[table].write.mode("overwrite").parquet(f"{folder}/{table}")
    return LazyTables(
        {t: (lambda t=t: tables[t].sparkSession.read.schema(tables[t].schema).parquet(f"{folder}/{t}")) for t in tables}
    )


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    """A published parquet table, or some of its columns."""
    table = spark.read.parquet(f"{folder}/{name}")
    return table.select(*columns) if columns else table


def read_csv_result(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(f"{folder}/{name}", header=True, multiLine=True, escape='"')


def read_report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.json(f"{folder}/{name}", multiLine=True)
