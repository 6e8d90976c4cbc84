"""Every query against its SQL, on the smallest tables."""

import duckdb
import pytest

from driftlake.plans import registry

from .oracle import assert_same, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, con, name):
    assert_same(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def _display_against_sql(spark, tmp_path, keys):
    duckdb.sql(f"COPY ({keys}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    assert_same(registry.QUERIES["byte_display"](spark, str(tmp_path)), duck(str(tmp_path)), registry.ORACLES["byte_display"])


def test_byte_display_halves(spark, tmp_path):
    """Every fiftieth key is half a hundredth of a gigabyte away from the next one: above, below or exactly."""
    _display_against_sql(spark, tmp_path, "SELECT 25 * i AS o_orderkey FROM range(30000) t(i)")


def test_byte_display_any_key(spark, tmp_path):
    """Numbers of all lengths, both signs, and around the next gigabyte."""
    _display_against_sql(
        spark,
        tmp_path,
        """SELECT CAST(hash(i) >> (i % 60 + 1) AS BIGINT) * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END AS o_orderkey FROM range(6000) t(i)
        UNION ALL SELECT 9223372036854775807 UNION ALL SELECT -9223372036854775808 UNION ALL SELECT 4990 + i FROM range(20) t(i) UNION ALL SELECT 4999999970 + i FROM range(60) t(i)""",
    )


def test_byte_display_null_key(spark, tmp_path):
    _display_against_sql(spark, tmp_path, "SELECT CASE WHEN i % 3 <> 0 THEN i * 1700 END AS o_orderkey FROM range(9) t(i)")
