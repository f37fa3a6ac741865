"""Streams equal their batch forms."""

from bidloom.operators import jobs
from bidloom.plans import catalogue

DIR = "/root/testdata/sf0.001"


def test_change_feed(spark):
    batch = {r["event_id"] for r in catalogue.queries()["status_changes"](spark, DIR).collect()}
    assert {r["event_id"] for r in catalogue.queries()["stream_status_changes"](spark, DIR).collect()} == batch


def test_admissions_equal_fold(spark):
    got = {r["event_id"]: r["accepted"] for r in catalogue.queries()["stream_admissions"](spark, DIR).collect()}
    want = jobs.limiter(catalogue.read(spark, DIR, "events"), "user_id", "ts", "event_id", 5, 259200.0)
    assert got == {r["event_id"]: r["accepted"] for r in want.collect()} and not all(got.values())
