"""Tables in one file of one row group are worked on by as many tasks as shuffles have."""

from __future__ import annotations

import pytest

from voxlake.plans import files, parsed, tables

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [files._files, parsed._plans], ids=["files", "plans"])
def test_tables_are_dealt_to_tasks(spark, rows):
    made = rows(spark, FOLDER)
    assert tables.table(spark, FOLDER, "part").rdd.getNumPartitions() == 1
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
