import os
import sys
import time

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare  # noqa: E402


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Vectors enough to make each of the six rule groups larger than a playlist may be."""
    folder = tmp_path_factory.mktemp("large")
    rows = spark.range(3300).selectExpr("id AS vec_id", "CAST(id % 5 AS INT) AS label", "array(CAST(id AS FLOAT)) AS embedding")
    rows.coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return str(folder), engine


@pytest.mark.parametrize("name", ["run_from_cache_links", "run_update_links"])
def test_links_of_split_groups_equal_their_sql(spark, large, name):
    folder, engine = large
    _, rows, verdict = compare(spark, engine, folder, name)
    assert (rows, verdict) == (3300, "equal")


def test_renewed_links_do_not_hang_on_the_local_time_zone(spark, tmp_path, monkeypatch):
    rows = spark.range(120).selectExpr("id AS vec_id", "CAST(id % 5 AS INT) AS label", "array(CAST(id AS FLOAT)) AS embedding")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    with monkeypatch.context() as local:
        local.setenv("TZ", "America/New_York")
        time.tzset()
        found = compare(spark, engine, str(tmp_path), "run_update_links")[1:]
    time.tzset()
    assert found == (120, "equal")
