"""Stable pseudo-random numbers from a row key.

``rand()`` is recomputed when a task is retried or a cached block is lost, so
a row could land in a different part on recomputation. Hashing the key gives
the same draw every time, on every engine: the first 32 bits of
``md5(seed | key)`` as an unsigned integer, scaled to [0, 1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296


def hash32(seed: str | int, key: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def hash32_sql(seed: str | int, key: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR))), 1, 8) AS BIGINT)"


def stable_uniform(seed: str | int, key: Column) -> Column:
    """u in [0, 1), exact multiple of 2^-32."""
    return hash32(seed, key) / F.lit(float(TWO_32))


def stable_uniform_sql(seed: str | int, key: str) -> str:
    return f"({hash32_sql(seed, key)} / CAST('{float(TWO_32)!r}' AS DOUBLE))"


def stable_part(seed: str | int, key: Column, n: int) -> Column:
    """floor(u * n) in 0..n-1, in integers: (h * n) >> 32."""
    if n <= 0:
        raise ValueError("number of parts must be positive")
    return F.shiftright(hash32(seed, key) * F.lit(n).cast("bigint"), 32)


def stable_part_sql(seed: str | int, key: str, n: int) -> str:
    return f"(({hash32_sql(seed, key)} * CAST({n} AS BIGINT)) >> 32)"
