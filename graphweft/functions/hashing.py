"""Seeded random numbers. Keys and uniform draws are built-in expressions. 64-bit numbers that wrap around, which Spark's own
arithmetic refuses to make, are numpy's, a batch of rows at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

# Fixed values of the splitmix64 finaliser and of the coin's two inputs.
SPLITMIX_STEP = 0x9E3779B97F4A7C15
SPLITMIX_FIRST = 0xBF58476D1CE4E5B9
SPLITMIX_SECOND = 0x94D049BB133111EB
COIN_SALT = 0xA24BAED4963EE407
COIN_NODE = 0x9E3779B97F4A7C15


def signed(x: int) -> int:
    """The long with the bits of an unsigned number."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _bits(x: pa.Array) -> np.ndarray:
    """The bits of longs; null has those of 0."""
    return x.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 of 64-bit numbers."""
    z = x + np.uint64(SPLITMIX_STEP)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(SPLITMIX_FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(SPLITMIX_SECOND)
    return z ^ (z >> np.uint64(31))


def mix64(x: Column) -> Column:
    """splitmix64 of a long's bits."""

    @F.arrow_udf(LongType())
    def mixed(x: pa.Array) -> pa.Array:
        return pa.array(mix(_bits(x)).view(np.int64))

    return mixed(x.cast("long"))


def mix64_int(x: int) -> int:
    """splitmix64 of a number known to the driver."""
    mask = (1 << 64) - 1
    z = (x + SPLITMIX_STEP) & mask
    z = ((z ^ z >> 30) * SPLITMIX_FIRST) & mask
    z = ((z ^ z >> 27) * SPLITMIX_SECOND) & mask
    return z ^ z >> 31


def coin(center: Column, neighbour: Column, fraction: float, seed: int) -> Column:
    """Is the edge from neighbour to center among the fraction drawn? The other direction is another draw."""
    if fraction > 1:
        raise ValueError("fraction must be 1 at most")
    if fraction <= 0:
        return F.lit(False)
    salt, limit = np.uint64(mix64_int((seed & (1 << 64) - 1) ^ COIN_SALT)), np.uint64(int(fraction * (1 << 53)))

    @F.arrow_udf(BooleanType())
    def drawn(center: pa.Array, neighbour: pa.Array) -> pa.Array:
        inner = mix((_bits(center) * np.uint64(COIN_NODE)) ^ _bits(neighbour))
        return pa.array((mix(inner ^ salt) >> np.uint64(11)) < limit)

    return drawn(center.cast("long"), neighbour.cast("long"))


def key(*parts: Column | str | int) -> Column:
    """A sort key below 2 ** 32 drawn from the parts; SQL engines with md5 give the same. Always add an id for ties."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) drawn from the parts."""
    return key(*parts) / F.lit(float(1 << 32))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
