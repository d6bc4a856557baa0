"""Every registered query of the engine is written in full, so that no column is pruned and no error hidden."""

import pytest

from tracemill import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_runs_in_full(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
