from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trendloom.operators import timestamps as ts

SITES = [("hanoi", "Asia/Ho_Chi_Minh", "dmy"), ("york", "America/New_York", "mdy"), ("nepal", "Asia/Kathmandu", "dmy"), (None, None, None)]


def us(*a, micro=0):
    return int((datetime(*a) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 + micro


CASES = [
    ("hanoi", "2025-09-20T02:44:31.164Z", us(2025, 9, 20, 2, 44, 31, micro=164000)),
    ("hanoi", "2025-09-20 09:00", us(2025, 9, 20, 2)),
    ("hanoi", "20/09/2025 09:00", us(2025, 9, 20, 2)),
    ("york", "09/20/2025 05:00", us(2025, 9, 20, 9)),
    ("york", "05:00:07 09/20/2025", us(2025, 9, 20, 9, 0, 7)),
    ("york", "20/09/2025 05:00", None),  # no 20th month
    (None, "20/09/2025 05:00", None),  # no order, no clock
    (None, "2025-09-20 05:00", None),
    (None, "2025-09-20 05:00:00+05:45", us(2025, 9, 19, 23, 15)),
    ("elsewhere", "2025-09-20 05:00", None),
    ("york", "2025-11-02 01:30", None),  # twice
    ("york", "2026-03-08 02:30", None),  # never
    ("york", "2025-11-02T01:30:00-04:00[America/New_York]", us(2025, 11, 2, 5, 30)),
    ("hanoi", "2025-11-02T01:30:00[America/New_York]", None),
    ("hanoi", "2025-11-02T03:30:00[America/New_York]", us(2025, 11, 2, 8, 30)),
    ("hanoi", "2025-11-02T03:30:00[Mars/Base]", None),
    ("hanoi", "1758342137", 1758342137 * 1_000_000),
    ("hanoi", "1758342137123", 1758342137123 * 1000),
    ("hanoi", "1758342137123456", 1758342137123456),
    ("hanoi", "1758342137123456789", 1758342137123456),
    ("hanoi", "2025-09-20T03:34:33.468531063Z", us(2025, 9, 20, 3, 34, 33, micro=468531)),
    ("hanoi", "lúc 15:43:35 UTC+7 20 tháng 9, 2025", us(2025, 9, 20, 8, 43, 35)),
    ("nepal", "lúc 05:45:00 1 tháng 10, 2025", us(2025, 10, 1)),
    ("york", "Thứ sáu, 10/10/2025, 00:16 (GMT+7)", us(2025, 10, 9, 17, 16)),
    ("york", "Sun, 21 Sep 2025 13:40:53 -0400", us(2025, 9, 21, 17, 40, 53)),
    ("york", "20 Sep 2025, 05:12 UTC", us(2025, 9, 20, 5, 12)),
    ("hanoi", "2025-09-20 08:52:08 ICT", us(2025, 9, 20, 1, 52, 8)),
    ("hanoi", "2025-09-20 08:52:08 XYZ", None),
    ("hanoi", "21/09/2025 02:35 AM", us(2025, 9, 20, 19, 35)),
    ("hanoi", "21/09/2025 12:05 AM", us(2025, 9, 20, 17, 5)),
    ("hanoi", "21/09/2025 13:35 PM", None),
    ("hanoi", "2025-09-21T25:61:00Z", None),
    ("hanoi", "31/02/2026 11:26", None),
    ("hanoi", "2025-09-27", None),
    ("hanoi", "07:08", None),
    ("hanoi", "Hôm qua lúc 04:32", None),
    ("hanoi", "9 giờ trước", None),
    ("hanoi", "tháng 9, 2025", None),
    ("hanoi", "", None),
    ("hanoi", None, None),
    ("hanoi", "x" * 100_000, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(n, s, v, datetime(2026, 1, 1), "clash") for n, (s, v, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "msg_id long, source string, time string, ingested_at timestamp_ntz, value string")
    sites = spark.createDataFrame(SITES, "source string, tz string, date_order string")
    return {r["msg_id"]: r["utc_us"] for r in ts.normalise_timestamps(df, sites, "msg_id", ["time"]).collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_value(parsed, n):
    assert parsed[n] == CASES[n][2], CASES[n][1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "msg_id long, source string, time string, ingested_at timestamp_ntz")
    sites = spark.createDataFrame([], "source string, tz string, date_order string")
    assert ts.normalise_timestamps(df, sites, "msg_id", ["time"]).count() == 0


def test_zone_is_estimated_from_ingestion(spark):
    """A source with no declared zone gets the one that its delays fit, repeated rows or not."""
    rows = [(k, "unknown", f"2025-{m:02d}-10 12:00", datetime(2025, m, 10, 16 if 3 <= m <= 10 and m != 3 else 17, 4)) for k, m in enumerate([1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12] * 20)]
    df = spark.createDataFrame(rows, "msg_id long, source string, time string, ingested_at timestamp_ntz")
    sites = spark.createDataFrame([("unknown", None, "dmy")], "source string, tz string, date_order string")
    got = ts.normalise_timestamps(df, sites, "msg_id", ["time"])
    us_ = {r["value"]: r["utc_us"] for r in got.collect()}
    assert us_["2025-07-10 12:00"] == us(2025, 7, 10, 16) and us_["2025-01-10 12:00"] == us(2025, 1, 10, 17)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.datetimes(datetime(1980, 1, 1), datetime(2090, 1, 1)), min_size=1, max_size=20))
def test_round_trip(spark, times):
    rows = [(n, None, t.strftime("%Y-%m-%dT%H:%M:%S.%f") + "Z", datetime(2026, 1, 1)) for n, t in enumerate(times)]
    df = spark.createDataFrame(rows, "msg_id long, source string, time string, ingested_at timestamp_ntz")
    sites = spark.createDataFrame(SITES, "source string, tz string, date_order string")
    got = {r["msg_id"]: r["utc_us"] for r in ts.normalise_timestamps(df, sites, "msg_id", ["time"]).collect()}
    assert [got[n] for n in range(len(times))] == [us(*t.timetuple()[:6], micro=t.microsecond) for t in times]
