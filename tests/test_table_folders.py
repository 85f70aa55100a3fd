"""Streams over given tables that are folders of part files, as larger tables are."""

import os

import pytest

from eventlens.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare


@pytest.fixture(scope="module")
def folders(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("folders"))
    for name in os.listdir(sf):
        if name in ("pages.parquet", "events.parquet"):
            spark.read.parquet(f"{sf}/{name}").repartition(3).write.parquet(f"{root}/{name}")
        else:
            os.symlink(f"{sf}/{name}", f"{root}/{name}")
    return root


@pytest.mark.parametrize("name", ["x1_incremental_landing", "x6_sample_isolation", "x7_time_bucket_counts"])
def test_a_stream_reads_a_table_of_part_files(spark, folders, oracle, name):
    error, rows = compare(spark, oracle, name, QUERIES[name], ORACLES[name], folders)
    assert error is None and rows, error
