"""Writing tables: upserts by key and staged replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new delivers, and all of new; stale rows of a delivered key vanish. Null keys in new never replace."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns))


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Overwrite a Parquet table, partitioned where a column is given."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
