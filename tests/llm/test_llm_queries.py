from pathlib import Path

import pytest

from tarnflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {"p4_found": ["vec_a", "vec_b"], "p6_found": ["doc_id", "item_id"], "p7_found": ["source"], "p8_found": ["doc_id"]}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
@pytest.mark.parametrize("name", QUERIES)
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0
