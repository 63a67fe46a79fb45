import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_is_at_least_nine_tenths(spark, size):
    got = {r["index"]: r.recall for r in entry.queries()["recall_of_indexes"](spark, f"/root/testdata/{size}").collect()}
    assert set(got) == {"ivf_partial", "ivfpq_residual"} and min(got.values()) >= 0.9
