"""Table sinks: overwrite, append, schema merging, create-if-absent, insert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _writer(df: DataFrame, mode: str, path: str | None):
    writer = df.write.format("parquet").mode(mode)
    return writer.option("path", path) if path else writer


def overwrite_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    _writer(df, "overwrite", path).saveAsTable(name)
    return df.sparkSession.table(name)


def append_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Append by column name; the table is created when it does not exist."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        df = df.select(*spark.table(name).columns)
    _writer(df, "append", path).saveAsTable(name)
    return spark.table(name)


def merge_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` in the merged schema: old columns first, absent ones null.

    This is the frame to write when a table is overwritten with new columns.
    """
    return old.limit(0).unionByName(new, allowMissingColumns=True)


def append_merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows in the merged schema."""
    return old.unionByName(new, allowMissingColumns=True)


def append_merging(df: DataFrame, path: str) -> DataFrame:
    """Append to stored parquet whose columns may differ; read in the merged schema,
    where columns that a row was written without are null."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.option("mergeSchema", "true").parquet(path)


def create_table_if_absent(
    spark: SparkSession, name: str, schema: StructType, path: str | None = None
) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{place}")


def insert_rows(df: DataFrame, name: str) -> DataFrame:
    """Insert a query's rows, matched to the table's columns by name."""
    spark = df.sparkSession
    df.select(*spark.table(name).columns).write.insertInto(name)
    return spark.table(name)
