from datetime import date, datetime, timezone

import pandas as pd
from pandas.tseries.holiday import (
    AbstractHolidayCalendar, GoodFriday, Holiday, USLaborDay, USMartinLutherKingJr, USMemorialDay,
    USPresidentsDay, USThanksgivingDay, nearest_workday, sunday_to_monday,
)
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal


class Independent(AbstractHolidayCalendar):
    rules = [
        Holiday("a", month=1, day=1, observance=sunday_to_monday),
        USMartinLutherKingJr, USPresidentsDay, GoodFriday, USMemorialDay,
        Holiday("b", month=6, day=19, start_date=pd.Timestamp("2022-06-19"), observance=nearest_workday),
        Holiday("c", month=7, day=4, observance=nearest_workday),
        USLaborDay, USThanksgivingDay,
        Holiday("d", month=12, day=25, observance=nearest_workday),
    ]


def test_sessions_match_an_independent_calendar(spark):
    got = [r.session for r in cal.trading_calendar(spark, "2015-01-01", "2030-12-31").orderBy("session").collect()]
    closed = {d.date() for d in Independent().holidays("2015-01-01", "2030-12-31")} | {date(2025, 1, 9)}
    want = [d.date() for d in pd.bdate_range("2015-01-01", "2030-12-31") if d.date() not in closed]
    assert got == want


def test_early_closes_and_neighbours(spark):
    rows = {r.session: r for r in cal.trading_calendar(spark, "2025-01-01", "2025-12-31").collect()}
    early = sorted(d for d, r in rows.items() if r.early_close)
    assert early == [date(2025, 7, 3), date(2025, 11, 28), date(2025, 12, 24)]
    assert rows[date(2025, 1, 10)].previous_session == date(2025, 1, 8)
    assert rows[date(2025, 5, 30)].last_of_month and not rows[date(2025, 5, 29)].last_of_month
    winter, summer = rows[date(2025, 1, 8)], rows[date(2025, 7, 8)]
    assert (winter.regular_open.hour, summer.regular_open.hour) == (14, 13)


def test_phases_are_half_open_and_follow_the_zone(spark):
    def utc(*parts):
        return datetime(*parts, tzinfo=timezone.utc)

    cases = [
        (utc(2026, 8, 24, 7, 59), None), (utc(2026, 8, 24, 8, 0), "PRE_MARKET"),
        (utc(2026, 8, 24, 13, 30), "REGULAR"), (utc(2026, 8, 24, 20, 0), "POST_MARKET"),
        (utc(2026, 8, 25, 0, 0), None), (utc(2026, 1, 6, 0, 30), "POST_MARKET"),
        (utc(2025, 11, 28, 17, 59), "REGULAR"), (utc(2025, 11, 28, 18, 0), "POST_MARKET"),
        (utc(2025, 1, 9, 15, 0), None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t timestamp")
    got = {r.i: r.p for r in df.select("i", cal.session_phase(F.col("t")).alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [phase for _, phase in cases]


def test_session_completion_and_months(spark):
    row = spark.range(1).select(
        cal.extended_session_complete(F.lit("2026-08-24").cast("date"), F.lit("2026-08-24 23:59:00").cast("timestamp")).alias("open"),
        cal.extended_session_complete(F.lit("2026-08-24").cast("date"), F.lit("2026-08-25 00:00:00").cast("timestamp")).alias("done"),
        cal.months_before(F.lit("2024-03-31").cast("date"), 1).alias("m"),
    ).first()
    assert (row.open, row.done, row.m) == (False, True, date(2024, 2, 29))
