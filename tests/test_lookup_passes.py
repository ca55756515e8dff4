from pyspark.sql import functions as F

from trackweave.catalog import cache_queries
from trackweave.operators.extraction import MEASURE_DEFAULTS

SF_DIR = "/root/testdata/sf0.001"


def test_hits_and_misses_come_from_one_lookup(spark):
    listed = cache_queries.cached_and_fresh(spark, SF_DIR)
    leaves = listed._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n")
    assert leaves.count("l_shipdate") == 1
    missed = listed.where("NOT is_hit")
    assert missed.count() and missed.where((F.col("bpm") == MEASURE_DEFAULTS["bpm"]) & (F.col("key") == MEASURE_DEFAULTS["key"])).count() == missed.count()
