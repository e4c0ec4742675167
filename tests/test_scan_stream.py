"""Scans checked while their pages land."""

from __future__ import annotations

import datetime as dt

from hypothesis import given, strategies as st

from quillspark.streaming.scan_stream import ENTRIES, PAGES, ScanChecks, united

BEGUN = dt.datetime(2031, 5, 1, 8, tzinfo=dt.timezone.utc)


def page(scan, offset, papers, total, minutes, begun=0):
    started = BEGUN + dt.timedelta(hours=begun)
    return scan, started, started + dt.timedelta(minutes=minutes, seconds=7), offset, total, papers


def landing(spark, checks, pages, entries=()):
    rows = [(scan, BEGUN, BEGUN + dt.timedelta(minutes=5), i) for scan, i in entries]
    checks.land(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rows, ENTRIES))
    checks.drain()


def found(checks):
    return {r.scan: tuple(r)[1:] for r in checks.verdicts().collect()}


def test_verdicts_over_restarts(spark, tmp_path):
    root = str(tmp_path)
    landing(spark, ScanChecks(spark, root), [
        page("whole", 0, 40, 70, 1), page("gap", 0, 40, 90, 1), page("gap", 80, 10, 90, 3), page("drift", 0, 40, 80, 1),
        page("empty", 0, 0, 0, 1), page("short", 5, 5, 10, 2)], [("whole", "a"), ("whole", "b"), ("gap", "a")])
    assert found(ScanChecks(spark, root)) == {"empty": ("complete", 0, 0, None)}
    # The second run finds the state of the first; a page that lands again changes nothing.
    landing(spark, ScanChecks(spark, root), [
        page("whole", 0, 40, 70, 20), page("whole", 40, 30, 70, 21), page("drift", 40, 40, 79, 25)],
            [("whole", "a"), ("gap", "c")])
    early = {"empty": ("complete", 0, 0, None), "whole": ("complete", 70, 70, None), "drift": ("drift", 80, 80, None)}
    assert found(ScanChecks(spark, root)) == early
    # A page after the six hours belongs to no scan, and another scan's page shows that the time is up.
    landing(spark, ScanChecks(spark, root), [page("gap", 40, 40, 90, 361), page("next", 0, 10, 30, 1, begun=7)],
            [("whole", "a")])
    checks = ScanChecks(spark, root)
    assert found(checks) == early | {"gap": ("expired", 50, 90, 40), "short": ("expired", 5, 10, 0)}
    assert [tuple(r) for r in checks.repeated().collect()] == [("whole", "a", 3)]
    checks.drain()
    assert len(found(checks)) == checks.verdicts().count() == 5


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30))))
def test_union_of_spans(spans):
    result = united(spans)
    assert {n for b, e in result for n in range(b, e)} == {n for b, e in spans for n in range(b, e)}
    assert all(a[1] < b[0] for a, b in zip(result, result[1:]))
