"""Seeded pseudo-random numbers that depend on keys only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def seeded_hash(seed, *keys: Column | str) -> Column:
    """The first 60 bits of md5("seed:key:..."), as a BIGINT in [0, 2**60)."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def run_key(base: Column, settings: list[tuple[Column, object, str]]) -> Column:
    """A run's name: ``base`` and every setting that differs from its default.

    ``settings`` holds (value, default, prefix); a NULL value counts as the default.
    """
    marks = [
        F.when(value.isNotNull() & (value.cast("string") != F.lit(str(default))),
               F.concat(F.lit(prefix), value.cast("string")))
        for value, default, prefix in settings
    ]
    return F.concat_ws("_", base, *marks)


def record_id(*parts: Column | str) -> Column:
    """Hyphen-joined id, writer first."""
    return F.concat_ws("-", *parts)


def content_key(*parts: Column | str) -> Column:
    """Digest that is equal for equal content."""
    return F.sha1(F.concat_ws("\x1f", *parts))
