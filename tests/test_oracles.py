"""Every registered query of the engine that has SQL, against DuckDB at the smallest scale; the others give rows of a stable shape."""

import pytest

from cladeframe.plans import catalog
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert_same(catalog.queries()[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", ["as2_link", "as4_track", "as5_motion_relink", "as20_ungated_then_cut"])
def test_links_are_one_to_one_and_gated(spark, name):
    df = catalog.queries()[name](spark, SF).toPandas()
    source, target = ("left_id", "right_id") if "left_id" in df else ("source", "target")
    assert df[target].is_unique and len(df)
    if "kind" in df:
        df = df[df.kind == "match"]
        assert (df.distance <= 15).all()
    assert df[source].is_unique


def test_entry_has_rows(spark):
    assert catalog.entry(spark, SF).count() == 1
