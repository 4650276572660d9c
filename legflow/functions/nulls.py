"""Small column helpers that encode the reference's missing-value semantics.

Q1: "drop rows where the condition holds" keeps rows whose condition is
undefined -> ``keep_unless``.
Q2: durations round half to even -> ``half_even_minutes``.
Q9: bad text becomes missing; NaN is missing -> ``to_double`` / ``nan_to_null``.
Q15: seeded row samples are a function of a row key -> ``uniform``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keep_unless(cond: Column) -> Column:
    """Filter predicate that drops rows where ``cond`` is TRUE only (NULL kept)."""
    return ~F.coalesce(cond, F.lit(False))


def nan_to_null(c) -> Column:
    c = col_(c)
    return F.when(~F.isnan(c), c)


def to_double(c) -> Column:
    """Numeric text or number to double; unparseable text and NaN to NULL."""
    return nan_to_null(col_(c).try_cast("double"))


def to_timestamp_ntz(c) -> Column:
    c = col_(c)
    return c.try_cast("timestamp_ntz")


def is_numeric_text(c) -> Column:
    """True when the value parses as a finite-or-infinite number."""
    return col_(c).try_cast("double").isNotNull()


def minutes_between(start, end) -> Column:
    """Exact (fractional) minutes from ``start`` to ``end``; works on NTZ."""
    return F.timestamp_diff("MICROSECOND", col_(start), col_(end)) / F.lit(float(MICROS_PER_MINUTE))


def half_even_minutes(start, end) -> Column:
    """Minutes between two timestamps, rounded half to even, as int."""
    return F.bround(minutes_between(start, end), 0).cast("int")


def uniform(key, seed: int, multiplier: int = 2654435761) -> Column:
    """Deterministic value in [0, 1) from a bigint key and a seed.

    The arithmetic form is the one the oracle SQL also computes, so
    samples and masks are checkable.  Give each column its own seed and
    odd multiplier (the sequence is low-discrepancy, not random).  The key is
    taken modulo 2**31 first, so the product fits a bigint for any key.
    """
    k = F.pmod(col_(key).cast("bigint"), F.lit(1 << 31))
    return ((k * F.lit(multiplier) + F.lit(seed * 40503)) % F.lit(4294967296)).cast("double") / F.lit(4294967296.0)


def uniform_sql(key: str, seed: int, multiplier: int = 2654435761) -> str:
    k = f"(((CAST({key} AS BIGINT) % {1 << 31}) + {1 << 31}) % {1 << 31})"
    return f"(CAST(({k} * {multiplier} + {seed * 40503}) % 4294967296 AS DOUBLE) / 4294967296.0)"


def hash_uniform(key, seed: int) -> Column:
    """Library default: xxhash64 of (key, seed) mapped to [0, 1)."""
    h = F.xxhash64(col_(key), F.lit(seed))
    return F.pmod(h, F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))
