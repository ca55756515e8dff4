"""A feature table laid out in buckets of its key, which joins on that key read without shuffling it.

For runs that look up or purge against the whole table again and again: only the keys of the other side move,
distinct and dealt to as many partitions as the table has buckets. One writer at a time; a table is written whole
and then read by any session, which needs no catalog but its own.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class BucketedTable:
    """Rows below ``folder`` by hash of ``key``; choose ``buckets`` so that one is about a gigabyte.

    Key and number are part of the path, so that no session can read the buckets of another layout as its own.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 64) -> None:
        self.spark, self.key, self.buckets = spark, key, buckets
        self.path = f"{folder.rstrip('/')}/{key}_{buckets}"
        self.name = f"bucketed_{uuid.uuid4().hex}"

    def write(self, rows: DataFrame) -> None:
        """Replace the table by ``rows``, a file for each bucket; ``rows`` must not read it."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        dealt = rows.repartition(self.buckets, self.key)
        writer = dealt.write.mode("overwrite").bucketBy(self.buckets, self.key).option("path", self.path)
        writer.saveAsTable(self.name)

    def rows(self) -> DataFrame:
        """All rows; a table that another session wrote is made known to this one first."""
        try:
            return self.spark.table(self.name)
        except AnalysisException:
            columns = self.spark.read.parquet(self.path).schema
            ddl = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in columns)
            self.spark.sql(
                f"CREATE TABLE {self.name} ({ddl}) USING parquet"
                f" CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )
            return self.spark.table(self.name)

    def _keys(self, others: DataFrame) -> DataFrame:
        """Distinct keys by bucket: repeated ones are gone before they could gather in one task."""
        return others.select(self.key).distinct().repartition(self.buckets, self.key)

    def matching(self, others: DataFrame) -> DataFrame:
        """Rows whose key is among those of ``others``; a null key matches none."""
        return self.rows().join(self._keys(others), self.key, "left_semi")

    def lacking(self, others: DataFrame) -> DataFrame:
        """Rows whose key is not among those of ``others``; those with a null key are."""
        return self.rows().join(self._keys(others), self.key, "left_anti")
