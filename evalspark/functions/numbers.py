"""Exact counts, safe division and number formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.hashing import as_column

# Plain decimal notation, plus the infinities; everything else is not a number here.
NUMBER_PATTERN = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def exact(count: Column | str) -> Column:
    """A count as an exact decimal, so that products of counts cannot overflow a bigint."""
    return as_column(count).cast("decimal(19,0)")


def to_number(text: Column | str) -> Column:
    """The text as a double, or null if it is not a number."""
    col = as_column(text)
    return F.when(col.rlike(NUMBER_PATTERN), F.trim(col).try_cast("double"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double; 0.0 where the denominator is zero."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def or_zero(value: Column | str) -> Column:
    """The value with null and NaN as 0.0."""
    return F.coalesce(F.nanvl(as_column(value), F.lit(0.0)), F.lit(0.0))


def decimals(value: Column, places: int) -> Column:
    """A fixed number of decimals; the pattern form rounds the exact binary value half to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places if places else "0"))


def fixed3(value: Column) -> Column:
    return decimals(value, 3)


def rounded(df, digits: int, *names: str):
    """Round the named columns (for reports and comparisons, never inside an operator)."""
    return reduce(lambda d, n: d.withColumn(n, F.round(F.col(n), digits)), names, df)
