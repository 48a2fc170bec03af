"""US equities sessions as column expressions: holidays, early closes, phases."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values ------------------------------------------------------------------------
EXCHANGE_ZONE = "America/New_York"
SCHEDULE_SOURCE = "canonical_us_equities_v1"
PRE_MARKET, REGULAR, POST_MARKET = "PRE_MARKET", "REGULAR", "POST_MARKET"
EXTENDED_OPEN, REGULAR_OPEN, REGULAR_CLOSE, EARLY_CLOSE, EXTENDED_CLOSE = (
    "04:00:00",
    "09:30:00",
    "16:00:00",
    "13:00:00",
    "20:00:00",
)
EXTRA_CLOSURES = ("2025-01-09",)
# -------------------------------------------------------------------------------------


def exchange_date(at: Column) -> Column:
    """Trading date of an instant: its calendar date in the exchange's zone."""
    return F.to_date(F.from_utc_timestamp(at, EXCHANGE_ZONE))


def _is_good_friday(day: Column) -> Column:
    """Two days before Easter, by the integer computus of the Gregorian calendar."""

    def whole(value: Column) -> Column:
        return F.floor(value).cast("int")

    year = F.year(day)
    golden, century, rest = year % 19, whole(year / 100), year % 100
    moon = (
        19 * golden + century - whole(century / 4) - whole((century - whole((century + 8) / 25) + 1) / 3) + 15
    ) % 30
    shift = (32 + 2 * (century % 4) + 2 * whole(rest / 4) - moon - rest % 4) % 7
    total = moon + shift - 7 * whole((golden + 11 * moon + 22 * shift) / 451) + 114
    easter = F.make_date(year, whole(total / 31), total % 31 + 1)
    return day == F.date_sub(easter, 2)


def is_holiday(day: Column) -> Column:
    """Full-day closures that fall on a weekday, by month, day of month and weekday."""
    month, dom, weekday = F.month(day), F.dayofmonth(day), F.weekday(day)
    monday, thursday, friday = weekday == 0, weekday == 3, weekday == 4

    def fixed(m: int, d: int, *, back: bool = True) -> Column:
        """A fixed date, moved to Monday from Sunday and (back) to Friday from Saturday."""
        moved = (dom == d) & (weekday < 5) | (dom == d + 1) & monday
        if back:
            moved = moved | (dom == d - 1) & friday
        return (month == m) & moved

    return (
        fixed(1, 1, back=False)
        | monday & month.isin(1, 2) & dom.between(15, 21)
        | monday & (month == 5) & (dom >= 25)
        | (F.year(day) >= 2022) & fixed(6, 19)
        | fixed(7, 4)
        | monday & (month == 9) & (dom <= 7)
        | thursday & (month == 11) & dom.between(22, 28)
        | fixed(12, 25)
        | friday & month.isin(3, 4) & _is_good_friday(day)
        | _is_extra_closure(day)
    )


def _is_extra_closure(day: Column) -> Column:
    return day.isin(*[date.fromisoformat(text) for text in EXTRA_CLOSURES])


def is_session(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~is_holiday(day)


def is_early_close(day: Column) -> Column:
    """July 3 before a weekday holiday, the Friday after Thanksgiving, and December 24."""
    month, dom, weekday = F.month(day), F.dayofmonth(day), F.weekday(day)
    return (
        (month == 7) & (dom == 3) & (weekday < 4)
        | (month == 11) & (weekday == 4) & dom.between(23, 29)
        | (month == 12) & (dom == 24) & (weekday < 5)
    )


def _seconds(clock: str) -> int:
    hours, minutes, seconds = map(int, clock.split(":"))
    return hours * 3600 + minutes * 60 + seconds


def second_of_day(local: Column) -> Column:
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def bound(day: Column, clock: str) -> Column:
    """Instant (UTC) of a wall-clock time on a trading date."""
    local = F.concat_ws(" ", day.cast("string"), F.lit(clock)).cast("timestamp")
    return F.to_utc_timestamp(local, EXCHANGE_ZONE)


def regular_close(day: Column) -> Column:
    return F.when(is_early_close(day), bound(day, EARLY_CLOSE)).otherwise(
        bound(day, REGULAR_CLOSE)
    )


def session_phase(at: Column) -> Column:
    """PRE_MARKET / REGULAR / POST_MARKET by half-open bounds, null outside.

    Weekends and holidays are classified by the clock too, as only a listed full-market
    closure has no schedule.
    """
    local = F.from_utc_timestamp(at, EXCHANGE_ZONE)
    day, second = F.to_date(local), second_of_day(local)
    close = F.when(is_early_close(day), _seconds(EARLY_CLOSE)).otherwise(_seconds(REGULAR_CLOSE))
    return (
        F.when(
            (second < _seconds(EXTENDED_OPEN))
            | (second >= _seconds(EXTENDED_CLOSE))
            | _is_extra_closure(day),
            F.lit(None).cast("string"),
        )
        .when(second < _seconds(REGULAR_OPEN), F.lit(PRE_MARKET))
        .when(second < close, F.lit(REGULAR))
        .when(second >= close, F.lit(POST_MARKET))
    )


def trading_calendar(
    spark: SparkSession, start: date | str | Column, end: date | str | Column
) -> DataFrame:
    """Sessions between two dates with their four UTC bounds and neighbours.

    The dates may be columns without input, such as scalar subqueries over the data.
    """
    first, last = (
        day if isinstance(day, Column) else F.lit(str(day)).cast("date") for day in (start, end)
    )
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("session"))
    return with_neighbours(with_bounds(days.filter(is_session(F.col("session")))))


def with_bounds(sessions: DataFrame) -> DataFrame:
    day = F.col("session")
    return sessions.select(
        "session",
        bound(day, EXTENDED_OPEN).alias("extended_open"),
        bound(day, REGULAR_OPEN).alias("regular_open"),
        regular_close(day).alias("regular_close"),
        bound(day, EXTENDED_CLOSE).alias("extended_close"),
        is_early_close(day).alias("early_close"),
        F.lit(SCHEDULE_SOURCE).alias("source"),
    )


def with_neighbours(sessions: DataFrame) -> DataFrame:
    """Previous and next session and whether a session is the last of its month.

    The frame is one row per trading date (about 250 a year), so one ordered window over
    the calendar is bounded; it is partitioned by source all the same.
    """
    w = Window.partitionBy("source").orderBy("session")
    following = F.lead("session").over(w)
    return sessions.withColumns(
        {
            "previous_session": F.lag("session").over(w),
            "next_session": following,
            "last_of_month": F.coalesce(
                F.trunc(following, "month") > F.trunc(F.col("session"), "month"), F.lit(True)
            ),
        }
    )


def months_before(day: Column, months: int) -> Column:
    return F.add_months(day, -months)


def extended_session_complete(session: Column, now: Column) -> Column:
    """An earlier exchange date, or the same date at or after the extended close."""
    today = exchange_date(now)
    second = second_of_day(F.from_utc_timestamp(now, EXCHANGE_ZONE))
    return (session < today) | ((session == today) & (second >= _seconds(EXTENDED_CLOSE)))
