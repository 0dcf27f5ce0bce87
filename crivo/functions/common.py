"""Small column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(x: ColumnLike | float | int) -> Column:
    """Column from a name, a column, or a number."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def ladder(x: Column, steps: Iterable[tuple[float, object]], rest: object, op: str) -> Column:
    """First step whose bound holds (``x op bound``), tested in order; ``rest`` otherwise."""
    tests = {
        "<=": lambda b: x <= b,
        "<": lambda b: x < b,
        ">=": lambda b: x >= b,
        ">": lambda b: x > b,
    }
    out = None
    for bound, value in steps:
        cond, value = tests[op](F.lit(bound)), F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.lit(rest))


def lookup(key: Column, values: Mapping[str, object]) -> Column:
    """Literal map lookup, NULL for keys outside the map."""
    literal = F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))
    return F.try_element_at(literal, key)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_up_to(x: Column, step_inverse: int) -> Column:
    """Round to multiples of ``1/step_inverse``, ties towards plus infinity."""
    return F.floor(x * step_inverse + F.lit(0.5)) / F.lit(float(step_inverse))


def ceil_to(x: Column, step_inverse: int) -> Column:
    """Round up to multiples of ``1/step_inverse``."""
    return F.ceil(x * step_inverse) / F.lit(float(step_inverse))


def fixed(x: Column, digits: int) -> Column:
    """Plain decimal text with a fixed number of digits, no grouping, half-up."""
    return F.round(x, digits).cast(f"decimal(38,{digits})").cast("string")


def drop_nan(x: Column) -> Column:
    """NaN becomes NULL, so comparisons on it are never true."""
    return F.when(~F.isnan(x), x)
