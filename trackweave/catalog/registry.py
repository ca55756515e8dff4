"""All registered queries by name."""

from trackweave.catalog import cache_queries, cluster_queries, path_queries, rule_queries, run_queries

QUERIES = {
    **rule_queries.QUERIES,
    **cache_queries.QUERIES,
    **cluster_queries.QUERIES,
    **path_queries.QUERIES,
    **run_queries.QUERIES,
}
