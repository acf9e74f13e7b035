"""Numeric column helpers.

``round_half_up`` and ``hash_uniform`` are written so that any SQL engine with
IEEE doubles and md5 (the DuckDB oracle included) computes bit-identical
values: money rounding and the synthetic draws are part of the results.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the seed of every synthetic draw.
RANDOM_SEED = 42

_TWO_POW_32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d on the binary value.

    Spark's ``round`` rounds the shortest decimal text of the double, most
    other engines the scaled binary value; the two disagree on about 0.3 % of
    half-cent prices. This form is the same in every engine.
    """
    scale = float(10 ** digits)
    return F.floor(_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def round_cents(c, digits: int = 2) -> Column:
    """Nearest, ties to even on the scaled binary value: what NumPy and pandas
    do with a column of doubles (DuckDB: round_even(x * 10^d, 0) / 10^d)."""
    scale = float(10 ** digits)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def round_half_away(c, digits: int = 2) -> Column:
    """Nearest, ties away from zero, as a SQL warehouse rounds NUMERIC."""
    scale, x = float(10 ** digits), _col(c)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def safe_div(num, den) -> Column:
    """num / NULLIF(den, 0)."""
    den = _col(den)
    return F.when(den != 0, _col(num) / den)


def hash_uniform(*parts, tag: str, seed: int = RANDOM_SEED) -> Column:
    """Deterministic U[0, 1) draw keyed by ``parts`` and ``tag``.

    Replaces a sequential seeded PRNG: the value depends only on the row's
    key, so it is the same on any partitioning, on task retry and in SQL::

        ('0x' || substr(md5(concat_ws('#', key, tag, seed)), 1, 8))::BIGINT / 2^32
    """
    text = F.concat_ws("#", *[_col(p).cast("string") for p in parts], F.lit(tag), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(_TWO_POW_32)


def uniform_between(lo: float, hi: float, *parts, tag: str) -> Column:
    """lo + (hi - lo) * U[0, 1)."""
    return F.lit(lo) + F.lit(hi - lo) * hash_uniform(*parts, tag=tag)


def randint_between(lo: int, hi: int, *parts, tag: str) -> Column:
    """Integer uniform on [lo, hi], both ends included."""
    return (F.lit(lo) + F.floor(hash_uniform(*parts, tag=tag) * F.lit(hi - lo + 1))).cast("int")
