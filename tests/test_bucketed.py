import re

import pytest
from pyspark.sql import functions as F

from trackweave.operators import cache as C
from trackweave.sources.bucketed import BucketedTable


@pytest.fixture()
def features(spark):
    return spark.range(2000).select(
        F.when(F.col("id") % 500 != 3, F.concat(F.lit("/m/"), F.col("id"))).alias("file_path"), F.col("id").alias("n")
    )


@pytest.fixture()
def listing(spark):
    """Every third path, and one path very often."""
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, F.col("id") - F.col("id") % 3).otherwise(6).alias("id"))
    return rows.select(F.concat(F.lit("/m/"), "id").alias("file_path"))


def values(df):
    return sorted((r.file_path or "", r.n) for r in df.select("file_path", "n").collect())


def test_joins_equal_plain_ones(spark, features, listing, tmp_path):
    table = BucketedTable(spark, str(tmp_path), "file_path", 6)
    table.write(features)
    assert values(table.rows()) == values(features)
    assert values(table.matching(listing)) == values(C.present_rows(features, listing))
    assert values(table.lacking(listing)) == values(C.missing_rows(features, listing))
    assert table.matching(listing.limit(0)).count() == 0 and table.lacking(listing.limit(0)).count() == 2000


def test_another_session_reads_and_replaces_it(spark, features, listing, tmp_path):
    BucketedTable(spark, str(tmp_path), "file_path", 6).write(features)
    other = BucketedTable(spark.newSession(), str(tmp_path), "file_path", 6)
    assert values(other.rows()) == values(features)
    other.write(features.where("n < 10"))
    assert other.rows().count() == 10
    other.write(features.limit(0))
    assert other.rows().count() == 0


@pytest.mark.parametrize("reopened", [False, True])
def test_the_table_is_not_shuffled(spark, features, listing, tmp_path, capsys, reopened):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.enabled", "false")
    table = BucketedTable(session, str(tmp_path), "file_path", 6)
    table.write(features)
    if reopened:
        table = BucketedTable(session, str(tmp_path), "file_path", 6)
    others = session.createDataFrame([("/m/6",)], "file_path string")
    for joined in (table.matching(others), table.lacking(others)):
        capsys.readouterr()
        joined.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "SelectedBucketsCount: 6 out of 6" in plan
        table_side = plan[: plan.index("FileScan")]
        assert "Exchange" not in table_side and len(re.findall("Exchange hashpartitioning", plan)) == 2
