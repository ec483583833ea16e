"""Matrices held as arrays of rows (array<array<T>>), counted from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rectangular(m: Column) -> Column:
    """Whether all rows are equally long."""
    return F.size(F.array_distinct(F.transform(m, lambda r: F.size(r)))) <= 1


def row(m: Column, i: Column | int) -> Column:
    """A row; null where there is none."""
    return F.get(m, i if isinstance(i, Column) else F.lit(i))


def column(m: Column, j: Column | int) -> Column:
    """A column; null cells where rows are too short."""
    return F.transform(m, lambda r: F.get(r, j if isinstance(j, Column) else F.lit(j)))


def transposed(m: Column) -> Column:
    """Columns as rows; null where the matrix isn't rectangular, empty where it has no column."""
    width = F.size(F.get(m, F.lit(0)))
    none = F.slice(m, 1, 0)
    return F.when(F.size(m) == 0, none).when(rectangular(m) & (width == 0), none).when(rectangular(m), F.transform(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda j: F.transform(m, lambda r: F.get(r, j))))
