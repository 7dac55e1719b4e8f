"""Seeded hashes: the only source of randomness, so results never depend on row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: int | str, *parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def unit_uniform(hex_hash: Column) -> Column:
    """A uniform number in [0, 1) from the first 12 hex digits of a hash."""
    return F.conv(F.substring(hex_hash, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
