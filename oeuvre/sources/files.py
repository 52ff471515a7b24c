"""Readers and writers for the file formats of the inputs and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oeuvre.functions.columns import european_number

# Options of the delimited formats.  They serve files and from_csv / to_csv alike.
HEADER = {"header": "true", "sep": ",", "escape": '"'}
SEMICOLON = {"header": "true", "sep": ";", "escape": '"'}
NULL_TOKEN = {**HEADER, "nullValue": "NA"}
TABS = {"header": "false", "sep": "\t", "quote": ""}
QUOTED = {"header": "true", "sep": ",", "quoteAll": "true", "escape": '"'}


def catalog_table(spark: SparkSession, name: str, database: str | None = None) -> DataFrame:
    return spark.table(f"{database}.{name}" if database else name)


def parquet(spark: SparkSession, path: str, *columns: str, schema: str | None = None) -> DataFrame:
    """A Parquet table, reading only the named columns from the files."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df.select(*columns) if columns else df


def delimited(
    spark: SparkSession,
    path: str,
    options: dict[str, str] = HEADER,
    schema: str | None = None,
    renames: dict[str, str] | None = None,
) -> DataFrame:
    """A delimited file; without a schema every column is text.

    With a header, the columns of the schema are found by name, after ``renames``
    from the names of the file to those of the schema.  Others are not read, a
    value that does not fit its type is null, and an absent column is an error.
    Without a header the schema names the columns in their order.
    """
    reader = spark.read.options(**options)
    if schema and options.get("header") != "true":
        return reader.schema(schema).csv(path)
    text = reader.csv(path)
    text = text.withColumnsRenamed({k: v for k, v in (renames or {}).items() if k in text.columns})
    return typed(text, schema) if schema else text


def typed(text: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema from a table of text that has them in any order."""
    wanted = T.StructType.fromDDL(schema)
    absent = [c for c in wanted.names if c not in text.columns]
    if absent:
        raise ValueError(f"columns not in the header: {absent}")
    return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])


def european(spark: SparkSession, path: str, numbers: Sequence[str] = ()) -> DataFrame:
    """A file with ``;`` between columns and ``,`` in numbers."""
    text = delimited(spark, path, SEMICOLON)
    return text.withColumns({c: european_number(c) for c in numbers})


def tabs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated file without header, its columns named by the schema."""
    return delimited(spark, path, TABS, schema)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records, one on each line; absent fields are null."""
    return spark.read.schema(schema).json(path)


def write_quoted(df: DataFrame, path: str) -> None:
    """A CSV folder in which every value is quoted.  Null and empty text look the
    same in it, so steps hand over to each other in Parquet instead."""
    df.write.options(**QUOTED).csv(path, mode="overwrite")


def write_report(df: DataFrame, path: str) -> None:
    df.write.options(**HEADER).csv(path, mode="overwrite")
