import pytest

from oracle import same, twin
from tabloom.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return twin(SF)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_twin(spark, con, name):
    same(core.QUERIES[name](spark, SF), con, core.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_runs(spark, name):
    rows = core.QUERIES[name](spark, SF).collect()
    assert sum(r["n"] for r in rows) == 6000 and len(rows) <= 8
