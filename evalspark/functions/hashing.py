"""Content-derived identifiers and order keys.

Everything that needs a "random" choice takes it from SHA-256 of the content, so that results
do not depend on row order, partitioning or retried tasks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.fixed import ARTIFACT_HASH_LENGTH, SEED


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sha16(text: Column | str) -> Column:
    """Artifact id: the first 16 hex characters of the text's SHA-256."""
    return F.substring(F.sha2(as_column(text), 256), 1, ARTIFACT_HASH_LENGTH)


def hash8(text: Column | str) -> Column:
    """The first 8 hex characters of the text's SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(as_column(text), 256), 1, 8), 16, 10).cast("bigint")


def order_key(*parts: Column | str, seed: int = SEED) -> Column:
    """A seeded, uniformly distributed hex key that orders rows by their identity."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[as_column(p).cast("string") for p in parts]), 256)
