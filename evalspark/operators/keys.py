"""Joins on several key columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Equi-join that keeps the left side's key columns.

    With ``null_safe`` a null key matches a null key, for user columns such as strata or labels.
    Plain keys are the default, since only they reuse a partitioning that is already there.
    """
    if not keys:
        raise ValueError("a join needs keys")
    if not null_safe:
        return left.join(right, list(keys), how)
    right = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[f"_right_{k}"]) for k in keys]
    )
    joined = left.join(right, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])
