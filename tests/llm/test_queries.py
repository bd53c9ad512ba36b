import os

import pytest

from collatio.llm.queries import ORACLE_SQL, QUERIES
from tests import duck

pytestmark = pytest.mark.skipif(not os.path.isdir(duck.SF_DIR), reason="no tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE_SQL:
        duck.same(spark, duck.connect(), QUERIES[name], ORACLE_SQL[name])
    else:
        docs = spark.read.parquet(f"{duck.SF_DIR}/documents.parquet").count()
        assert QUERIES[name](spark, duck.SF_DIR).count() == docs
