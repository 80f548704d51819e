"""Every query of the registry against its SQL twin, or that it runs with a stable schema."""

import pytest
from compare import check

from orrery.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    if name in registry.ORACLES:
        check(df, duck, registry.ORACLES[name])
    else:
        assert df.columns and df.count() >= 0


def test_twins_have_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
