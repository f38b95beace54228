"""Ordered rules over one row: the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, ...]], otherwise: tuple, names: tuple[str, ...]) -> list[Column]:
    """One column per name; rules are (condition, value, ...). A condition that is null does not hold."""
    out = []
    for i, name in enumerate(names):
        column = None
        for condition, *values in rules:
            value = _value(values[i])
            column = F.when(condition, value) if column is None else column.when(condition, value)
        out.append(column.otherwise(_value(otherwise[i])).alias(name))
    return out


def _value(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
