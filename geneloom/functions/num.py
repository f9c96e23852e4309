"""Numeric helpers and vector expressions: ``Column -> Column``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import _col, to_number  # noqa: F401  (to_number is part of this surface)

# Ordinal protein level scale.
LEVEL_SCALE = {"Not detected": 0.0, "Low": 1.0, "Medium": 2.0, "High": 3.0}


def signed_log1p(c) -> Column:
    c = _col(c)
    return F.signum(c) * F.log1p(F.abs(c))


def ordinal_level(c, scale: dict[str, float] | None = None) -> Column:
    """Ordinal code of a level; NULL for anything outside the scale."""
    expr = None
    for word, value in (scale or LEVEL_SCALE).items():
        expr = F.when(_col(c) == word, F.lit(value)) if expr is None else expr.when(_col(c) == word, F.lit(value))
    return expr


def safe_std(c) -> Column:
    """Divisor of a z-score: a zero deviation becomes one."""
    return F.when(_col(c) == 0, F.lit(1.0)).otherwise(_col(c))


def character_sum(c, modulus: int = 100000) -> Column:
    letters = F.filter(F.split(F.coalesce(_col(c), F.lit("")), ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0), lambda a, x: a + F.ascii(x)) % modulus


def percent(part, whole, digits: int = 4) -> Column:
    return F.bround(F.lit(100.0) * _col(part) / _col(whole), digits)


def indexed_name(prefix: str, index, start: int = 0) -> Column:
    return F.concat(F.lit(prefix), (_col(index) + F.lit(start)).cast("string"))


def offset_name(group, offset) -> Column:
    return F.concat(_col(group), F.lit("_offset_"), F.format_string("%+d", _col(offset)))


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def is_finite(v) -> Column:
    inf = F.lit(float("inf"))
    return F.forall(_col(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


def count_nan(v) -> Column:
    return F.size(F.filter(_col(v), lambda x: F.isnan(x)))


def count_inf(v) -> Column:
    return F.size(F.filter(_col(v), lambda x: F.abs(x) == F.lit(float("inf"))))


def as_float_vector(v) -> Column:
    return _col(v).cast("array<float>")


def as_double_vector(v) -> Column:
    return _col(v).cast("array<double>")


def wide_to_vector(cols) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def vector_to_wide(v, dim: int, prefix: str = "dim_", start: int = 0) -> list[Column]:
    return [F.get(_col(v), F.lit(i)).alias(f"{prefix}{i + start}") for i in range(dim)]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x, bits: int):
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64(x, seed) -> np.ndarray:
    """Spark's ``xxhash64`` of 32 or 64 bit integers, as unsigned numbers; the hash of a further column takes that of the one before as ``seed``."""
    x = np.asarray(x)
    seed = np.asarray(seed).astype(np.uint64)
    with np.errstate(over="ignore"):
        if x.dtype.itemsize == 4:
            h = (seed + _P5 + np.uint64(4)) ^ (x.astype(np.uint32).astype(np.uint64) * _P1)
            h = _turned(h, 23) * _P2 + _P3
        else:
            h = (seed + _P5 + np.uint64(8)) ^ (_turned(x.astype(np.uint64) * _P2, 31) * _P1)
            h = _turned(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))
