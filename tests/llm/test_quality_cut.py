import numpy as np
import pytest

from test_quality_groups import rejected, table
from vexel.llm import quality


def test_moderate_outlier_is_rejected(spark):
    got = quality.verdicts(table(spark, 5)).where("doc_id = 9999").first()
    assert 18.47 < got.distance < 120 and not got.kept
    assert rejected(spark, 5) == {9999}


def test_constants_of_normal_rows():
    x = np.random.default_rng(1).normal(size=(400_000, 4))
    d = (x * x).sum(axis=1)
    part = x[d <= np.quantile(d, 0.75)]
    assert quality.consistency(4, 0.75) == pytest.approx(1 / part.var(axis=0).mean(), rel=0.01)
    assert quality.CUT == pytest.approx(18.467, abs=0.001)
