import os

import pytest

from collatio.plans.queries import ORACLE_SQL, QUERIES
from tests import duck

pytestmark = pytest.mark.skipif(not os.path.isdir(duck.SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def db():
    return duck.connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    if name in ORACLE_SQL:
        duck.same(spark, db, QUERIES[name], ORACLE_SQL[name])
    else:
        assert QUERIES[name](spark, duck.SF_DIR).count() > 0


def test_opcodes_tile_both_sides(spark):
    for r in QUERIES["align_opcodes"](spark, duck.SF_DIR).groupBy("juan_label").agg({"i2": "max", "i1": "min"}).collect():
        assert r["min(i1)"] == 0
