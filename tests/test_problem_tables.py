"""Problems without SQL against brute force over whole small tables."""

import os

import pytest

from quarryline.plans import problems
from tests import brute

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def dicts(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{D}/{name}.parquet").collect()]


def test_p6_found(spark):
    tables = [("repos", "audit_date", dicts(spark, "repos")), ("findings", "last_updated", dicts(spark, "findings")), ("finding_events", "occurred_at", dicts(spark, "finding_events"))]
    got = [tuple(r) for r in problems.p6_found(spark, D).select("table_name", "row_no", "field_name", "epoch_ms").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute.p6(tables)


def test_p5_found(spark):
    got = [tuple(r) for r in problems.p5_found(spark, D).select("repo_key", "event_id", "outcome").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute.p5(dicts(spark, "finding_events"))


def test_p2_found(spark):
    got = [tuple(r) for r in problems.p2_found(spark, D).select("file_name", "field_name", "change_kind").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute.p2(dicts(spark, "raw_records"))
