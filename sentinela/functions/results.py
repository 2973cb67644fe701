"""Three-valued laboratory results.

TRUE is positive, FALSE is negative and NULL means the test does not apply. A
NULL never turns into FALSE here: every decode is a CASE without an ELSE.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions)


def has_result(*names: str, except_codes: tuple[str, ...] = ()) -> Column:
    """At least one of the columns holds a value other than the given "no result" codes."""
    def known(name: str) -> Column:
        filled = F.col(name).isNotNull()
        if not except_codes:
            return filled
        return filled & ~F.col(name).cast("string").isin(*except_codes)

    return any_of(known(n) for n in names)


def any_equals(value, *names: str) -> Column:
    """Any of the columns equals the value; "unknown or false" stays unknown.

    Pass a string for columns with text codes: comparing those with a number raises in
    ANSI mode. A string is compared as text whatever the column's type.
    """
    def compared(name: str) -> Column:
        return F.col(name).cast("string") if isinstance(value, str) else F.col(name)

    return any_of(compared(n) == F.lit(value) for n in names)


def decode(applies: Column, positive: Column) -> Column:
    """The result where the test applies, NULL where it does not or that is unknown."""
    return F.when(applies, positive)


def known_negative(name: str) -> Column:
    """TRUE only for a negative result; an untested column gives FALSE."""
    return F.coalesce(~F.col(name), F.lit(False))


def flag_set(name: str) -> Column:
    """A 0/1 flag equal to 1, with NULL read as not set."""
    return F.coalesce(F.col(name) == 1, F.lit(False))


def admitted_or_unknown(admitted: Column, emergency: Column) -> Column:
    """Hospital disposition "admitted": also when either flag is unknown."""
    return admitted | ~emergency | admitted.isNull() | emergency.isNull()


def emergency_only(admitted: Column, emergency: Column) -> Column:
    return emergency & ~admitted


def disposition(admitted: Column, emergency: Column) -> Column:
    """Both dispositions as one grouping column; the two conditions never overlap."""
    return F.when(emergency_only(admitted, emergency), "emergency").otherwise("admitted")
