"""Calendar functions: quarters, filing deadlines, Republic of China years, relative dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month and day on which a quarter's report is due, the fourth in the next year.
DEADLINES = {1: (5, 15), 2: (8, 14), 3: (11, 14), 4: (3, 31)}
ROC_OFFSET = 1911


def roll_weekend(d: Column) -> Column:
    """Saturdays and Sundays move to Monday."""
    day = F.weekday(d)
    return F.date_add(d, F.when(day == 5, 2).when(day == 6, 1).otherwise(0))


def quarter_label(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def canonical_quarter(q: Column) -> Column:
    """'2013Q1' from '2013Q1' or '2013-Q1'; null otherwise."""
    y, n = F.regexp_extract(q, r"^(\d{4})-?Q([1-4])$", 1), F.regexp_extract(q, r"^(\d{4})-?Q([1-4])$", 2)
    return F.when(n != "", F.concat(y, F.lit("Q"), n))


def _year(q: Column) -> Column:
    return F.try_to_number(F.substring(canonical_quarter(q), 1, 4), F.lit("9999")).cast("int")


def _number(q: Column) -> Column:
    return F.try_to_number(F.substring(canonical_quarter(q), 6, 1), F.lit("9")).cast("int")


def quarter_start(q: Column) -> Column:
    return F.make_date(_year(q), 3 * _number(q) - 2, F.lit(1))


def quarter_end(q: Column) -> Column:
    return F.last_day(F.make_date(_year(q), 3 * _number(q), F.lit(1)))


def next_quarter(q: Column) -> Column:
    return quarter_label(F.add_months(quarter_start(q), 3))


def filing_deadline(q: Column) -> Column:
    """The day on which a quarter's report is due, moved off weekends; what is used more than once is bound, not repeated."""

    def due(x: Column) -> Column:
        n, y = F.substring(x, 6, 1).cast("int"), F.substring(x, 1, 4).cast("int")
        day = None
        for k, (month, date) in DEADLINES.items():
            made = F.make_date(y + (1 if k == 4 else 0), F.lit(month), F.lit(date))
            day = F.when(n == k, made) if day is None else day.when(n == k, made)
        return day

    days = F.transform(F.array(canonical_quarter(q)), due)
    return F.get(F.transform(days, roll_weekend), F.lit(0))


def roc_month(text: Column) -> Column:
    """The first day of the month in a text such as '112 年 02 月份', whose year counts from 1911."""
    pattern = r"(\d{2,3})\s*年\s*(\d{1,2})\s*月"
    y, m = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(y != "", F.make_date(y.try_cast("int") + ROC_OFFSET, m.try_cast("int"), F.lit(1)))


def to_roc_year(d: Column) -> Column:
    return F.year(d) - ROC_OFFSET


def month_ends(lo: Column, hi: Column) -> Column:
    """The ends of the months from ``lo`` to ``hi``, without the first."""
    return F.slice(F.transform(F.sequence(F.trunc(lo, "MM"), F.trunc(hi, "MM"), F.expr("interval 1 month")), F.last_day), 2, 10_000)


def month_gap(lo: Column, hi: Column, less: int = 3) -> Column:
    return (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo) - less


def relative_time(text: Column, now: Column) -> Column:
    """'3 hours ago' and '2 days ago' before ``now``, the digits before the unit counting; else an ISO time, an ISO day or
    a day such as 'January 5, 2024' or 'Jan 5, 2024'; else ``now``."""
    low = F.lower(text)
    absolute = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy")), now)
    out = absolute
    for unit in ("day", "hour"):
        digits = F.regexp_replace(F.substring_index(low, unit, 1), r"[^0-9]", "")
        n = F.when(low.contains(unit), digits.try_cast("int"))
        out = F.when(n.isNotNull(), now - F.make_interval(**{f"{unit}s": n})).otherwise(out)
    return out


def resume_day(latest: Column, today: Column, start: str = "2013-01-01") -> Column:
    """The day after the latest one, or ``start``; null if that is not before ``today``."""
    day = F.coalesce(F.date_add(latest, 1), F.lit(start).cast("date"))
    return F.when(day < today, day)


def cumulative_label(q: Column) -> Column:
    """What a year-to-date figure covers: '2013Q1', '2013Q1-2013Q3', or 'entire_2013' for the fourth quarter."""
    y, n = _year(q).cast("string"), _number(q)
    return F.when(n == 1, canonical_quarter(q)).when(n == 4, F.concat(F.lit("entire_"), y)).otherwise(F.concat(y, F.lit("Q1-"), canonical_quarter(q)))
