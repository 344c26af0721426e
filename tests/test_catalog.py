import pytest

from sheafline import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, duck, same):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLES:
        same(df, duck, catalog.ORACLES[name])
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
