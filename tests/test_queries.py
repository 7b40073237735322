"""Every registered query against its SQL on the smallest given tables."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry
import compare

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="given tables are absent")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    problem = compare.difference(entry.queries()[name](spark, SF_DIR), duck.sql(entry.oracle_sql()[name]))
    assert problem is None, problem


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
