import pytest

from tessera.plans import catalog
from tests.conftest import SF, canonical


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    known = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in known.description]
    assert sorted(found.columns) == sorted(names)
    assert canonical([tuple(r) for r in found.collect()], found.columns) == canonical(known.fetchall(), names)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
