"""Long/wide reshaping and completion, without self joins or cross products of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_flags(df: DataFrame, flags: Sequence[str], keep: Sequence[str],
                  drop: str = "null", name: str = "etiology", value: str = "result") -> DataFrame:
    """One row per flag column. ``drop`` is "null", "false" (NULL as well) or "nothing"."""
    cells = F.array(*[F.struct(F.lit(f).alias(name), F.col(f).alias(value)) for f in flags])
    if drop == "null":
        cells = F.filter(cells, lambda cell: cell[value].isNotNull())
    elif drop == "false":
        cells = F.filter(cells, lambda cell: cell[value])
    elif drop != "nothing":
        raise ValueError(f"drop must be null, false or nothing, not {drop!r}")
    return df.select(*keep, F.inline(cells))


def unpivot_records(df: DataFrame, keep: Sequence[str],
                    records: Sequence[Mapping[str, Column]]) -> DataFrame:
    """One output row per record of named expressions; all records share their names."""
    return df.select(*keep, F.inline(F.array(*[
        F.struct(*[column.alias(name) for name, column in record.items()])
        for record in records])))


def pivot_first(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str],
                cell: str, fill: str | None = None) -> DataFrame:
    """Spread one column over fixed headings; absent cells take ``fill`` or stay NULL."""
    wide = df.groupBy(*keys).pivot(column, list(values)).agg(F.first(cell, ignorenulls=True))
    if fill is None:
        return wide
    return wide.select(*keys, *[F.coalesce(F.col(f"`{v}`"), F.lit(fill)).alias(v) for v in values])


def listed_only(column: str, values: Sequence[str]) -> Column:
    """The column, failing the query at a value that would not get a heading of its own."""
    unlisted = F.raise_error(F.concat(
        F.lit(f"{column} without a heading: "), F.coalesce(F.col(column), F.lit("NULL"))))
    return F.when(F.col(column).isin(*values), F.col(column)).otherwise(unlisted.cast("string"))


def with_groups(df: DataFrame, by: Sequence[str], groups: Sequence[tuple] | None) -> DataFrame:
    """Add a row of NULLs for every listed group, so that it appears even without data.

    Without grouping columns the only group is the empty one.
    """
    groups = groups or ([()] if not by else [])
    if not groups:
        return df
    seed = df.sparkSession.range(0, 1, 1, 1)
    if by:
        seed = seed.select(F.inline(F.array(*[
            F.struct(*[F.lit(value).alias(name) for name, value in zip(by, group, strict=True)])
            for group in groups])))
    return df.unionByName(seed.select(*[
        F.col(f.name) if f.name in by else F.lit(None).cast(f.dataType).alias(f.name)
        for f in df.schema.fields]))


def ordered_codes(labels: Mapping[str, str]) -> list[tuple[int, str, str]]:
    """``(ord, code, label)`` of an etiology list, in display order."""
    return [(i, code, label) for i, (code, label) in enumerate(labels.items(), 1)]


def require_flags(df: DataFrame, flags: Sequence[str]) -> None:
    """Raise unless all the names are boolean columns."""
    types = dict(df.dtypes)
    missing = [f for f in flags if f not in types]
    if missing:
        raise ValueError(f"columns not found in the dataset: {', '.join(missing)}")
    wrong = [f for f in flags if types[f] != "boolean"]
    if wrong:
        raise ValueError(f"columns that are not boolean: {', '.join(wrong)}")
