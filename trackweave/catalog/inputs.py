"""Inputs the registered queries share, all derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """A registered query and, where SQL can say it, the SQL that checks it."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Track features out of `orders`: the same text runs in Spark and in the checking engine.
TRACKS_SQL = """
SELECT CAST(o_orderkey AS STRING) AS file_hash,
  '/music/' || o_orderpriority || '/t' ||
    CAST(o_orderkey - (CASE WHEN o_orderkey % 50 = 7 THEN 1 ELSE 0 END) AS STRING) || '.mp3' AS file_path,
  CASE WHEN o_orderkey % 101 = 0 THEN CAST(NULL AS DOUBLE)
       WHEN o_orderkey % 200 = 3 THEN CAST(175 AS DOUBLE)
       WHEN o_orderkey % 2 = 0   THEN CAST(100 + (o_orderkey * 37) % 30 AS DOUBLE)
       ELSE CAST(50 + (o_orderkey * 37) % 110 AS DOUBLE) END AS bpm,
  o_totalprice * o_totalprice / 3.125e7 AS centroid,
  CASE WHEN o_orderkey % 200 = 3 THEN 9e-1
       WHEN o_custkey % 2 = 0 THEN CAST(50 + o_custkey % 20 AS DOUBLE) / 1e2
       ELSE CAST((o_custkey * 13) % 85 AS DOUBLE) / 1e2 END AS danceability,
  CASE WHEN o_orderkey % 200 <> 3 AND o_orderkey % 10 < 7 THEN -1
       WHEN o_orderkey % 97 = 0 THEN CAST(NULL AS INT)
       ELSE CAST((o_orderkey * 7 + o_custkey) % 13 AS INT) END AS key,
  CAST(o_custkey % 3 % 2 AS INT) AS scale,
  CAST((o_orderkey * 11) % 400 AS DOUBLE) AS duration,
  CAST((o_orderkey * 17) % 101 AS DOUBLE) / 1e2 AS beat_confidence,
  o_orderkey AS ingest_seq,
  o_orderdate AS last_analyzed,
  o_orderstatus AS status,
  o_custkey AS owner
FROM {orders}
"""

# CTE prefix for checking SQL: WITH tracks AS (...)
TRACKS = "WITH tracks AS (" + TRACKS_SQL.replace("{orders}", "orders") + ")"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRACKS_SQL, orders=table(spark, sf_dir, "orders"))


def case(value: str, steps: list[tuple[float | None, str]]) -> str:
    """Checking SQL of a label ladder, written from the published cut-offs."""
    whens = " ".join(f"WHEN {value} < {bound}e0 THEN '{name}'" for bound, name in steps[:-1])
    return f"CASE WHEN {value} IS NULL THEN NULL {whens} ELSE '{steps[-1][1]}' END"
