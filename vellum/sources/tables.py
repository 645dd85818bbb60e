"""Reading and writing collections: Parquet tables and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..collection import Collection


def parquet(spark: SparkSession, path: str, id_col: str | None = None) -> Collection:
    return Collection(spark.read.parquet(path), id_col)


def import_json(spark: SparkSession, path: str, schema: T.StructType | str, id_col: str | None = None, array: bool = False) -> Collection:
    """JSON lines, or one array (array=True), with comments, single quotes and bare names allowed; schema is given, not guessed."""
    reader = spark.read.schema(schema).option("allowUnquotedFieldNames", True).option("allowSingleQuotes", True).option("allowComments", True).option("allowNonNumericNumbers", True).option("mode", "FAILFAST")
    return Collection(reader.option("multiLine", array).json(path), id_col)


def export_json(df: DataFrame, path: str) -> None:
    """One document per line, null fields included."""
    df.write.option("ignoreNullFields", False).json(path)


def rewrite(collection: Collection, path: str) -> Collection:
    """A compact copy, sorted by key, in a new folder; an existing one is an error."""
    df = collection.df
    if collection.id_col:
        df = collection.df.repartitionByRange(collection.id_col).sortWithinPartitions(collection.id_col)
    df.write.mode("errorifexists").parquet(path)
    return Collection(df.sparkSession.read.parquet(path), collection.id_col)
