"""Keyed Parquet tables, upserted by Spark's dynamic partition overwrite.

A table is one Parquet folder partitioned by hash bucket of its keys. An upsert reads the buckets its keys fall into,
keeps the newest row of each key, and overwrites these partitions and no others.

One writer at a time, and readers between writes: whoever needs more takes a table format. A change that was
broken off is applied again and gives the same table, since it is stated by keys and rows; batches of a stream are
kept by their number until they have been applied, so a replayed batch has the very rows it had.

A bucket is cut by the hash of its keys into as many tasks and files as its rows need, so no task grows with the table.
Choose ``buckets`` by how much of the table a small change should rewrite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.operators.cache import latest_per_key
from trackweave.schema import FEATURES_SCHEMA, empty_table, evolve_features
from trackweave.session import settle_small, store
from trackweave.sources import storage

BUCKETS = 16
# Rows of a table that one task ranks and writes, about.
ROWS_PER_TASK = 1 << 18


class KeyedTable:
    """A table with unique ``keys``; among rows of one key the largest ``newest_by`` wins.

    ``seq`` names a bigint column that numbers rows in order of arrival. Every bucket holds one row without keys: it
    keeps the partition in being when its last row goes, and its ``seq`` is the largest number given so far.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType,
        keys: list[str],
        newest_by: list[str],
        seq: str = "",
        buckets: int = BUCKETS,
    ):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        self.newest_by, self.seq, self.buckets = newest_by, seq, buckets
        # Inside one batch the sequence numbers do not exist yet: the other columns decide,
        # all of them, so a recomputed task picks the same row.
        known = [c for c in newest_by if c != seq]
        self.batch_order = known + [c for c in schema.names if c not in {*known, *keys, seq}]

    def _count(self) -> int:
        """Buckets of the table on disk, 0 while there is none."""
        return sum(n.startswith("bucket=") for n in storage.child_names(self.spark, f"{self.root}/rows"))

    def _bucket(self, count: int) -> Column:
        keys = [F.col(k).cast(self.schema[k].dataType) for k in self.keys]
        return F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int")

    def _dealt(self, rows: DataFrame, written: int, count: int, size: int) -> DataFrame:
        """``rows`` of ``written`` buckets with their bucket and the ``part`` of it that a task gets; ``size`` rows in all."""
        parts = max(1, -(-size // (ROWS_PER_TASK * max(written, 1))))
        keys = [F.col(k).cast(self.schema[k].dataType) for k in self.keys]
        # Another hash than the bucket's, which leaves only some remainders to a bucket.
        part = F.pmod(F.xxhash64(F.lit("part"), *keys), F.lit(parts)).cast("int")
        dealt = rows.withColumns({"bucket": self._bucket(count), "part": part})
        return dealt.repartition(count * parts, "bucket", "part")

    def _load(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def _rows(self, buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets, or of all; other partitions are not listed for reading."""
        rows = self._load().where(F.col(self.keys[0]).isNotNull())
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def read(self) -> DataFrame:
        """The rows in force, one for each key; an absent table is empty. Nothing is shuffled."""
        if not self._count():
            return empty_table(self.spark, self.schema)
        return self._rows().select(*self.schema.names)

    def top(self) -> int:
        """The largest sequence number ever given: only the rows without keys are looked at."""
        if not self.seq or not self._count():
            return -1
        found = self._load().where(F.col(self.keys[0]).isNull()).agg(F.max(self.seq)).first()[0]
        return -1 if found is None else found

    def _write(self, rows: DataFrame, buckets: list[int], count: int, top: int) -> None:
        """Overwrite the partitions ``buckets`` with ``rows``."""
        names = [*self.schema.names, "bucket"]
        marks = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
        blank = {c: F.lit(None).cast(self.schema[c].dataType) for c in self.schema.names}
        if self.seq:
            blank[self.seq] = F.lit(top).cast("bigint")
        # Settled first: a partition cannot be overwritten while it is read.
        settled = store(rows.select(*self.schema.names))
        dealt = self._dealt(settled, len(buckets), count, settled.count()).select(*names)
        # Blank rows are a file of their own.
        ordered = dealt.sortWithinPartitions("bucket").unionByName(marks.withColumns(blank).select(*names).coalesce(1))
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/rows")

    def _touched(self, keys: DataFrame, count: int) -> list[int]:
        """Buckets to write for some keys; all of them if the files are older than the schema, so that none stays behind."""
        if set(self.schema.names) - set(self.spark.read.parquet(f"{self.root}/rows").columns):
            return list(range(count))
        return sorted(r[0] for r in keys.select(self._bucket(count)).distinct().collect())

    def _numbered(self, rows: DataFrame) -> DataFrame:
        """The newest row of each key of a batch, numbered on from the largest number given."""
        newest = latest_per_key(rows, self.keys, [F.desc_nulls_last(c) for c in self.batch_order])
        if self.seq:
            newest = newest.withColumn(self.seq, F.monotonically_increasing_id() + F.lit(self.top() + 1))
        return newest.select(*self.schema.names)

    def append(self, rows: DataFrame, stream: str = "", batch: int = -1) -> None:
        """Upsert ``rows``; of each key the newest row stays, whether stored or new.

        A ``stream``'s batch is written under its number before it is applied; one that comes again is taken from there, and
        its predecessor is then no longer needed.
        """
        if stream:
            folder = f"{self.root}/batches/{stream}"
            if "_SUCCESS" not in storage.child_names(self.spark, f"{folder}/{batch}"):
                self._numbered(rows).write.mode("overwrite").parquet(f"{folder}/{batch}")
            fresh = self.spark.read.parquet(f"{folder}/{batch}")
            for name in storage.child_names(self.spark, folder):
                if name.isdigit() and int(name) < batch:
                    storage.delete(self.spark, f"{folder}/{name}")
        else:
            # Settled: a recomputed task must not number rows in another way.
            fresh = store(self._numbered(rows))
        if fresh.isEmpty():
            return
        count = self._count()
        buckets = self._touched(fresh, count) if count else list(range(self.buckets))
        old = self._rows(buckets).select(*self.schema.names) if count else empty_table(self.spark, self.schema)
        count = count or self.buckets
        both = self._dealt(old.unionByName(fresh), len(buckets), count, old.count() + fresh.count())
        # Bucket and part lead the window's keys: rows meet where they were dealt to.
        kept = latest_per_key(both, ["bucket", "part", *self.keys], [F.desc_nulls_last(c) for c in self.newest_by])
        top = max(self.top(), fresh.agg(F.max(self.seq)).first()[0]) if self.seq else -1
        self._write(kept.drop("bucket", "part"), buckets, count, top)

    def forget(self, keys: DataFrame) -> None:
        """Delete the rows of ``keys``; rows added later count again."""
        gone = settle_small(keys.select(*self.keys).distinct())
        count = self._count()
        if not count or gone.isEmpty():
            return
        buckets = self._touched(gone, count)
        rows = self._rows(buckets).select(*self.schema.names)
        self._write(rows.join(gone, self.keys, "left_anti"), buckets, count, self.top())

    def rewrite(self, rows: DataFrame) -> None:
        """Replace the whole table by ``rows`` (one row per key)."""
        count = self._count() or self.buckets
        settled = store(rows.select(*self.schema.names))
        top = self.top()
        if self.seq:
            top = max(top, settled.agg(F.coalesce(F.max(self.seq), F.lit(-1))).first()[0])
        self._write(settled, list(range(count)), count, top)


class FeatureTable(KeyedTable):
    """Track features by content hash; files written before a column existed give its default."""

    def __init__(
        self, spark: SparkSession, root: str, newest_by: list[str] | None = None, buckets: int = BUCKETS
    ):
        order = newest_by or ["ingest_seq"]
        super().__init__(spark, root, FEATURES_SCHEMA, ["file_hash"], order, "ingest_seq", buckets)
        recent = ["last_modified", "last_analyzed"]
        self.batch_order = recent + [c for c in self.batch_order if c not in recent]

    def _load(self) -> DataFrame:
        return evolve_features(super()._load())
