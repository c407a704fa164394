"""Every query outside the training-data package against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from compare import compare, connect
from gridloom.plans import queries, registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q in registry.SQL])
def test_sql_agrees(spark, con, name):
    assert compare(spark, con, DATA, name) == ""


def test_every_query_has_sql_but_for_fits():
    assert set(queries.QUERIES) - set(registry.SQL) == {"test_p_values", "logreg_fit", "sweep", "pca_fit"}
