"""Tables cut from their lineage."""

from __future__ import annotations

import os

from ridgeflow.session import cut_lineage, cuts_removed


def test_cuts_of_a_block_are_removed(spark):
    kept = cut_lineage(spark.range(3))
    with cuts_removed():
        path = cut_lineage(spark.range(5)).inputFiles()[0]
        assert os.path.exists(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))
    assert kept.count() == 3
