"""Distillation scores every assignment."""

from crossweave.plans import catalog
from crossweave.plans import proxies as px

SF = "/root/testdata/sf0.001"


def test_every_assignment_is_scored(spark):
    got = catalog.QUERIES["distilled_scores"](spark, SF).select("aid1", "pid")
    want = px.assignments(spark, SF, "O").select("aid", "pid").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
