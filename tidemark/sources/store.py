"""Named tables in the session's catalog, and what is known about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tidy import union


class Store:
    """Tables of one database, as Parquet."""

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.database = spark, database
        spark.sql(f"create database if not exists `{database}`")

    def _name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def write(self, table: str, df: DataFrame, *, replace: bool = True) -> int:
        """Replace or extend a table; the number of rows that it then has."""
        df.write.format("parquet").mode("overwrite" if replace else "append").saveAsTable(self._name(table))
        return self.read(table).count()

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def sql(self, query: str) -> DataFrame:
        return self.spark.sql(query)

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def tidy(self, names: list[str]) -> DataFrame:
        """Union of those of the named tidy tables that exist; an error if none does."""
        there = set(self.tables())
        return union(self.read(n).select("date", "series", "value", "published") for n in names if n in there)


def manifest(tidy: DataFrame, name: str) -> DataFrame:
    """One row of facts: rows, series, first and last month, and a hash that ignores the order of rows."""
    row_hash = F.xxhash64("date", "series", "value", "published")
    return tidy.agg(F.count("*").alias("rows"), F.countDistinct("series").alias("series"), F.min("date").alias("first"), F.max("date").alias("last"), F.hex(F.bit_xor(row_hash)).alias("hash")).select(F.lit(name).alias("name"), "*")
