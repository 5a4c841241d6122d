"""Tables of the store in a relational database, by JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A table; with a numeric key and its bounds in parallel ranges. Filters and columns are pushed to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key is not None and bounds is not None:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def write_table(rows: DataFrame, url: str, table: str, mode: str = "append", connections: int = 8, **options: str) -> None:
    """Rows to a table over a bounded number of connections; nested columns as JSON, as databases have no type for them."""
    nested = {f.name for f in rows.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    flat = rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns])
    flat.write.format("jdbc").mode(mode).options(url=url, dbtable=table, numPartitions=connections, **options).save()
