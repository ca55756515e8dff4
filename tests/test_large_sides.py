"""The paths taken when nothing may be broadcast and paths are compared by fingerprint."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare, connect  # noqa: E402

from trackweave import session  # noqa: E402
from trackweave.operators import cache, grouping, ranking  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    "name", ["playlist_positions", "cluster_positions", "cache_upsert_latest", "cache_lookup_hits", "unlink_changed"]
)
def test_results_do_not_depend_on_broadcasts(spark, monkeypatch, name):
    for module in (session, cache, grouping, ranking):
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(session.settle_small, "__defaults__", (-1,))
    monkeypatch.setattr(grouping, "FINGERPRINT_ROWS", 0)
    assert compare(spark, connect(SF_DIR), SF_DIR, name)[2] == "equal"
