"""Report calendar: reference dates, Sunday weeks and period floors.

Everything is derived from an explicit run date, never from the clock, so a
report can be rebuilt for any past week and a retried task sees the same dates.
"""

from __future__ import annotations

import calendar as _cal
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case Spanish month names, January first.
SPANISH_MONTHS = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]

# Time scales and their Spanish axis names.
SCALE_NAMES = {"week": "Semana", "month": "Mes", "quarter": "Trimestre", "year": "Año"}


def scale_name(scale: str) -> str:
    """Axis name of a time scale; unknown scales are rejected."""
    if scale not in SCALE_NAMES:
        raise ValueError(f"unknown scale {scale!r}; use one of {sorted(SCALE_NAMES)}")
    return SCALE_NAMES[scale]


# --- column expressions -------------------------------------------------------

def sunday_of(date: Column) -> Column:
    """The Sunday on or before a date."""
    return F.date_sub(date, F.dayofweek(date) - 1)


def floor_date(date: Column, unit: str) -> Column:
    """First day of the week (from Sunday), month, quarter or year; ``day`` keeps the date."""
    day = F.to_date(date)
    if unit == "day":
        return day
    scale_name(unit)
    return sunday_of(day) if unit == "week" else F.trunc(day, unit)


def next_month_start(date: Column) -> Column:
    return F.add_months(F.trunc(date, "month"), 1)


def last_friday_of(run_date: Column) -> Column:
    """Two days before the Sunday on or before the run date."""
    return F.date_sub(sunday_of(run_date), 2)


def first_sunday_of(last_friday: Column) -> Column:
    """Sunday on or before the same day of the previous year."""
    return sunday_of(F.add_months(last_friday, -12))


def in_trailing_months(date: Column, last_friday: Column, months: int) -> Column:
    """Inclusive range of ``months`` months ending at ``last_friday`` (month ends clamp)."""
    return F.to_date(date).between(F.add_months(last_friday, -months), last_friday)


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds as a zone-free timestamp, so later date casts do not depend on the session."""
    origin = F.lit("1970-01-01").cast("timestamp_ntz")
    return origin + F.make_dt_interval(secs=seconds)


def parse_birth_date(text: Column) -> Column:
    """Year-month-day text as a date; NULL where it is not one.

    Dashes, slashes, dots or no separator at all. A cast, unlike a format parser,
    raises no exception inside the task for every text that is not a date.
    """
    dashed = F.translate(F.trim(text), "/.", "--")
    dashed = F.regexp_replace(dashed, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(dashed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), dashed.try_cast("date"))


def spanish_month(date: Column) -> Column:
    names = F.array(*[F.lit(m) for m in SPANISH_MONTHS])
    return F.element_at(names, F.month(date))


def epi_year_week(date: Column) -> tuple[Column, Column]:
    """Year and number of the Sunday-start week, both taken from its Wednesday."""
    wednesday = F.date_add(sunday_of(date), 3)
    week = F.floor((F.dayofyear(wednesday) - 1) / 7) + 1
    return F.year(wednesday), week.cast("int")


# --- literal dates of one report ----------------------------------------------

def _sunday(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.isoweekday() % 7)


def _shift_months(day: dt.date, months: int) -> dt.date:
    index = day.year * 12 + day.month - 1 + months
    year, month = index // 12, index % 12 + 1
    return dt.date(year, month, min(day.day, _cal.monthrange(year, month)[1]))


@dataclass(frozen=True)
class ReportDates:
    """The dates of one weekly report, as literals that push down to the scan."""

    run_date: dt.date

    @property
    def last_friday(self) -> dt.date:
        return _sunday(self.run_date) - dt.timedelta(days=2)

    @property
    def year(self) -> int:
        return self.last_friday.year

    @property
    def first_sunday(self) -> dt.date:
        return _sunday(_shift_months(self.last_friday, -12))

    @property
    def this_month_start(self) -> dt.date:
        return self.last_friday.replace(day=1)

    @property
    def last_month_start(self) -> dt.date:
        return _shift_months(self.this_month_start, -1)

    @property
    def next_month_start(self) -> dt.date:
        return _shift_months(self.this_month_start, 1)

    def trailing_start(self, months: int) -> dt.date:
        return _shift_months(self.last_friday, -months)

    def periods(self, service_date: Column) -> dict[str, Column]:
        """Report periods. Both bounds count, so a month's first day is in two of them."""
        return {
            "this_month": service_date.between(
                F.lit(self.this_month_start), F.lit(self.next_month_start)),
            "last_month": service_date.between(
                F.lit(self.last_month_start), F.lit(self.this_month_start)),
            "all_time": F.lit(True),
        }

    def period_headings(self) -> dict[str, str]:
        """Spanish column headings of the positivity table."""
        this_month = SPANISH_MONTHS[self.this_month_start.month - 1]
        last_month = SPANISH_MONTHS[self.last_month_start.month - 1]
        return {
            "this_month": f"Mes más reciente ({this_month}) (n, %)",
            "last_month": f"Mes anterior ({last_month}) (n, %)",
            "all_time": "Histórico (n, %)",
        }

    def captions(self, previous_years: int, months: int) -> dict[str, str]:
        """Texts shown beside the results: history years, map dates, data cut-off."""
        return {
            "history_years": f"{self.year - previous_years} a {self.year - 1}",
            "map_dates": f"{self.trailing_start(months)} a {self.last_friday}",
            "effort_dates": f"{self.first_sunday} a {self.last_friday}",
            "data_until": str(self.last_friday),
        }
