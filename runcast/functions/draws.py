"""Random-looking numbers that are a pure function of (seed, key).

Partitioning, retries and lost executors cannot change them, unlike ``rand(seed)``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DRAWS_PER_DIGEST = 4
_SPAN = float(2 ** 32)

# fixed values: the Lehmer generators' modulus and three of its well-known multipliers
LEHMER_MODULUS = 2 ** 31 - 1
LEHMER_MULTIPLIERS = (16807, 48271, 69621)


def digest(seed: int, key: Column, block: int = 0) -> Column:
    """32 hex digits, enough for four draws."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(str(block))).cast("binary"))


def _word(digest_column: Column, place: int) -> Column:
    return F.conv(F.substring(digest_column, 8 * place + 1, 8), 16, 10)


def uniform(digest_column: Column, place: int = 0) -> Column:
    """The draw at ``place`` 0..3 of a digest, strictly between 0 and 1."""
    return (_word(digest_column, place).cast("double") + F.lit(0.5)) / F.lit(_SPAN)


def stream_seeds(digest_column: Column) -> list[Column]:
    """One seed per Lehmer generator from a digest."""
    return [F.pmod(_word(digest_column, place).cast("bigint"), F.lit(LEHMER_MODULUS))
            for place in range(len(LEHMER_MULTIPLIERS))]


def normal_array(seeds: Sequence[Column], count: int) -> Column:
    """Array of ``count`` standard normal draws from the combined generators (Box-Muller).

    One vectorised call per Arrow batch: written out as column expressions the
    draws make a method too large for the JVM to compile.
    """
    pairs = -(-count // 2)
    jumps = [np.array([pow(multiplier, place + 1, LEHMER_MODULUS) for place in range(2 * pairs)], dtype=np.int64)
             for multiplier in LEHMER_MULTIPLIERS]

    @F.arrow_udf("array<double>")
    def draw(s0: pa.Array, s1: pa.Array, s2: pa.Array) -> pa.Array:
        total = sum(s.to_numpy(zero_copy_only=False)[:, None] * jump % LEHMER_MODULUS
                    for s, jump in zip((s0, s1, s2), jumps))
        uniforms = (total % LEHMER_MODULUS + 0.5) / LEHMER_MODULUS
        radius, angle = np.sqrt(-2.0 * np.log(uniforms[:, 0::2])), 2.0 * np.pi * uniforms[:, 1::2]
        normal = np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=2).reshape(len(total), -1)[:, :count]
        offsets = np.arange(0, count * (len(total) + 1), count, dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, normal.ravel())

    return draw(*seeds)
