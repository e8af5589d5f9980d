"""Portable, seedable hashing used for sampling, ordering and fixtures.

Every expression here has an exact DuckDB twin (md5 is the same digest in
both engines), so oracle SQL can rebuild any sample or fixture.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_key(key, salt: str) -> Column:
    """md5 hex of ``key || '|' || salt``: a seeded, plan-independent order key."""
    return F.md5(F.concat_ws("|", _col(key).cast("string"), F.lit(str(salt))))


def hash_mod(key, salt: str, m: int) -> Column:
    """First 6 hex digits of ``md5_key`` as an integer, modulo ``m``.

    DuckDB: ``('0x' || substr(md5(cast(k as varchar) || '|' || salt), 1, 6))::BIGINT % m``.
    """
    return F.conv(F.substring(md5_key(key, salt), 1, 6), 16, 10).cast("long") % F.lit(m)


def hash_prefix(key, salt: str, digits: int = 8) -> Column:
    """Leading ``digits`` hex digits of ``md5_key`` as a non-negative long;
    monotone with the hex string's order, so it can pre-filter a sort."""
    return F.conv(F.substring(md5_key(key, salt), 1, digits), 16, 10).cast("long")
