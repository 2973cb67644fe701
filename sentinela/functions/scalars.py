"""Scalar helpers: recodes, ages, rounding, text cells, clamping and noise."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(key: Column, table: Mapping) -> Column:
    """Value of a literal table, NULL where the key is absent or NULL."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.when(key.isNotNull(), F.try_element_at(pairs, key))


def recode(key: Column, table: Mapping) -> Column:
    """Like :func:`lookup`, but values outside the table stay as they are."""
    return F.coalesce(lookup(key, table), key)


def rank_in(key: Column, ordered: list) -> Column:
    """1-based place of a value in an ordered list; NULL for values outside it."""
    return lookup(key, {value: i for i, value in enumerate(ordered, 1)})


def site_type_of(code: Column) -> Column:
    """``H`` is a hospital, any other code a clinic, NULL stays NULL."""
    return F.when(code.isNotNull(), F.when(code == "H", "hospital").otherwise("centro de salud"))


def approximate_age_days(years: Column, months: Column, days: Column) -> Column:
    """Age in days from its parts; missing or negative months and days count as zero."""
    zero = F.lit(0)
    return years * 365 + F.greatest(zero, months * 30) + F.greatest(zero, days)


def percent(part: Column, whole: Column) -> Column:
    """Whole percentage, ties to even; NULL where the denominator is zero."""
    return F.bround(F.try_divide(part, whole) * 100)


def _shown(number: Column, missing: str) -> Column:
    return F.coalesce(number.cast("bigint").cast("string"), F.lit(missing))


def count_and_percent(part: Column, whole: Column) -> Column:
    """``12 (34%)``; an unknown count prints as NA, 0/0 as NaN and n/0 as Inf."""
    no_ratio = F.when(part == 0, "NaN").when(part > 0, "Inf").otherwise("NA")
    shown = F.when(whole == 0, no_ratio).otherwise(_shown(percent(part, whole), "NA"))
    return F.concat(_shown(part, "NA"), F.lit(" ("), shown, F.lit("%)"))


def positives_cell(positive: Column, tested: Column, pct: Column) -> Column:
    """``3 / 40 (8)``."""
    return F.concat(
        _shown(positive, "NA"), F.lit(" / "), _shown(tested, "NA"),
        F.lit(" ("), _shown(pct, "NA"), F.lit(")"))


def site_heading(department: Column, site: Column) -> Column:
    """``Department (Site)``, a missing part printed as NA."""
    na = F.lit("NA")
    return F.concat(F.coalesce(department, na), F.lit(" ("), F.coalesce(site, na), F.lit(")"))


def title_case(text: Column) -> Column:
    """Capital letter at the start of every word, also after a hyphen."""
    return F.array_join(F.transform(F.split(text, "-"), F.initcap), "-")


def hex_text(raw: Column) -> Column:
    """Raw bytes as lower-case hexadecimal text."""
    return F.lower(F.hex(raw))


def clamp(value: Column, upper: float) -> Column:
    """Limit to ``[0, upper]``; NULL and non-finite values pass through."""
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    limited = F.least(F.greatest(value, F.lit(0.0)), F.lit(float(upper)))
    return F.when(finite, limited).otherwise(value)


def valid(value: Column) -> Column:
    """The value, with NaN read as missing."""
    return F.when(~F.isnan(value), value)


def normal_noise(seed: int, *keys: Column) -> Column:
    """Standard normal noise that depends only on the seed and the row's keys.

    A hash-based Box-Muller draw: a recomputed partition repeats the same values,
    which a partition-seeded generator does not do after a shuffle.
    """
    def uniform(stream: int) -> Column:
        bits = F.xxhash64(F.lit(seed), F.lit(stream), *keys).bitwiseAND(F.lit((1 << 52) - 1))
        return (bits + F.lit(0.5)) / F.lit(float(1 << 52))

    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(1)))
    return radius * F.cos(F.lit(6.283185307179586) * uniform(2))
