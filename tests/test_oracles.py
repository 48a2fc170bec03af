"""Every registered query against its SQL, on the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracles import connect, difference  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf_dir, con, name):
    frame = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert frame.columns
        frame.collect()
        return
    message = difference(frame, con, sql)
    # Small tables may leave a filtered report empty on both sides.
    assert message is None or message == "EMPTY result", message


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
