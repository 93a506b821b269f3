"""Writers: messages as JSON values, tables as parquet, and rows that a table lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """``key, value``: each row as one JSON object, as a topic takes it."""
    return df.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def new_rows(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys the table lacks, of equal keys one; null keys count as new each time."""
    return df.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti")


def save_bundle(path: str, **tables: DataFrame) -> None:
    """Each table as parquet in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
