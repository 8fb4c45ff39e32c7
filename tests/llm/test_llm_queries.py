"""Every registered query of the subpackage, against its SQL twin where it has one."""

import pytest
from oracle import same

from hashloom.llm import registry

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracles()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    if name in ORACLES:
        same(df, ORACLES[name], SF)
    else:
        rows = df.collect()
        assert rows and len(set(rows)) == len(rows)
