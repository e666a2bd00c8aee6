"""Calendar arithmetic on DATE columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from periodica.functions.measures import as_col

UNITS = ("day", "week", "month", "quarter", "year")


def month_index(day: Column | str) -> Column:
    """Months since year zero: equal differences are equal calendar distances."""
    d = as_col(day)
    return F.year(d) * 12 + F.month(d) - 1


def month_end(day: Column | str) -> Column:
    return F.last_day(as_col(day))


def month_end_from_text(text: Column | str) -> Column:
    """'YYYY-MM' to its month end; an impossible month gives NULL."""
    return F.last_day(F.try_to_date(F.concat(F.trim(as_col(text)), F.lit("-01")), "yyyy-MM-dd"))


def shift_month_end(day: Column | str, months: int) -> Column:
    return F.last_day(F.add_months(as_col(day), months))


def last_complete_month(observed: Column | str, today: Column | None = None) -> Column:
    """End of the last month that the observations cover to its last day."""
    d = as_col(observed)
    if today is not None:
        d = F.least(d, today)
    return F.when(d == F.last_day(d), d).otherwise(F.last_day(F.add_months(d, -1)))


def last_complete_period(day: Column | str, frequency: Column | str) -> Column:
    """End of the last whole month, quarter or year at ``day``; others keep it."""
    d, f = as_col(day), as_col(frequency)
    tomorrow = F.date_add(d, 1)
    return (
        F.when(f == "monthly", F.date_sub(F.trunc(tomorrow, "MM"), 1))
        .when(f == "quarterly", F.date_sub(F.trunc(tomorrow, "QUARTER"), 1))
        .when(f == "yearly", F.date_sub(F.trunc(tomorrow, "YEAR"), 1))
        .otherwise(d)
    )


def bucket_start(day: Column | str, unit: str) -> Column:
    d = as_col(day)
    if unit == "day":
        return d
    if unit not in UNITS:
        raise ValueError(f"unknown bucket {unit!r}")
    return F.trunc(d, {"week": "WEEK", "month": "MM", "quarter": "QUARTER", "year": "YEAR"}[unit])


def bucket_end(start: Column | str, unit: str) -> Column:
    s = as_col(start)
    if unit == "day":
        return s
    if unit == "week":
        return F.date_add(s, 6)
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    return F.date_sub(F.add_months(s, months), 1)


def window_start(last: Column | str, months: int, earliest: Column | None = None) -> Column:
    """First day of the trailing ``months``: same day clamped, plus one."""
    s = F.date_add(F.add_months(as_col(last), -months), 1)
    return s if earliest is None else F.greatest(earliest, s)


def week_window_start(last: Column | str, earliest: Column | None = None) -> Column:
    s = F.date_sub(as_col(last), 6)
    return s if earliest is None else F.greatest(earliest, s)


def quarter_end(day: Column | str) -> Column:
    return F.date_sub(F.add_months(F.trunc(as_col(day), "QUARTER"), 3), 1)


def year_end(day: Column | str) -> Column:
    return F.make_date(F.year(as_col(day)), F.lit(12), F.lit(31))


def ten_day_part(day: Column | str) -> Column:
    d = F.dayofmonth(as_col(day))
    return F.when(d <= 10, 1).when(d <= 20, 2).otherwise(3)


def ten_day_index(day: Column | str) -> Column:
    """1 to 36: three spans per month."""
    return (F.month(as_col(day)) - 1) * 3 + ten_day_part(day)


def ten_day_end(day: Column | str) -> Column:
    d = as_col(day)
    part = F.dayofmonth(d)
    return (
        F.when(part <= 10, F.date_add(F.trunc(d, "MM"), 9))
        .when(part <= 20, F.date_add(F.trunc(d, "MM"), 19))
        .otherwise(F.last_day(d))
    )


def iso_year(day: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), as_col(day))


def leap_day_of_year(day: Column | str) -> Column:
    """Day of year on a leap calendar, so 1 March is 61 in every year."""
    d = as_col(day)
    return F.dayofyear(F.make_date(F.lit(2000), F.month(d), F.dayofmonth(d)))


def week_of_month(day: Column | str) -> Column:
    return F.floor((F.dayofmonth(as_col(day)) - 1) / 7).cast("int") + 1


# --- Friday rules -----------------------------------------------------------


def nearest_friday(day: Column | str) -> Column:
    """Monday to Friday map forward to that Friday, the weekend back to it."""
    d = as_col(day)
    return F.date_add(d, F.lit(4) - F.weekday(d))


def _first_friday_of(start: Column) -> Column:
    return F.date_add(start, (F.lit(4) - F.weekday(start) + 7) % 7)


def _last_friday_of(end: Column) -> Column:
    return F.date_sub(end, (F.weekday(end) - F.lit(4) + 7) % 7)


def period_friday(day: Column | str, unit: str) -> Column:
    """Nearest Friday kept inside the month, quarter or year of ``day``.

    A Friday before the period gives its first Friday, one after it its last.
    """
    d = as_col(day)
    start = bucket_start(d, unit)
    end = bucket_end(start, unit)
    f = nearest_friday(d)
    return F.when(f < start, _first_friday_of(start)).when(f > end, _last_friday_of(end)).otherwise(f)


def dekad_friday(day: Column | str) -> Column:
    """As the month rule, but a Monday belongs to the Friday before it."""
    d = as_col(day)
    start, end = F.trunc(d, "MM"), F.last_day(d)
    f = F.when(F.weekday(d) == 0, F.date_sub(d, 3)).otherwise(nearest_friday(d))
    return F.when(f < start, _first_friday_of(start)).when(f > end, _last_friday_of(end)).otherwise(f)


def week_friday(day: Column | str) -> Column:
    """Friday that closes the Saturday-to-Friday week of ``day``."""
    d = as_col(day)
    return F.date_add(d, (F.lit(4) - F.weekday(d) + 7) % 7)


def prior_year_friday(friday: Column | str) -> Column:
    """Friday nearest to the same day last year, inside that month."""
    return period_friday(F.add_months(as_col(friday), -12), "month")
