"""Counter-based randomness: a number depends on its keys only, whatever the partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2_147_483_647


def hash_uniform(seed: int, *keys: Column | str) -> Column:
    """A whole number from 0 to PRIME - 1: a Lehmer chain over the keys, three steps after the last."""
    x = F.lit(seed % PRIME).cast("long")
    for k in keys:
        x = (x * 48271 + (F.col(k) if isinstance(k, str) else k).cast("long") % PRIME + 11) % PRIME
    for m in (69621, 40692, 16807):
        x = (x * m + 12345) % PRIME
    return x


def uniform_sql(seed: int, *keys: str) -> str:
    """The same in SQL."""
    x = f"{seed % PRIME}::BIGINT"
    for k in keys:
        x = f"(({x} * 48271 + ({k})::BIGINT % {PRIME} + 11) % {PRIME})"
    for m in (69621, 40692, 16807):
        x = f"(({x} * {m} + 12345) % {PRIME})"
    return x


_LOW = 0xFFFFFFFF


def _times32(x: Column, constant: int) -> Column:
    """x * constant modulo 2^32, by halves, without overflow."""
    high, low = constant >> 16, constant & 0xFFFF
    return (x * low + F.shiftleft((x * high).bitwiseAND(0xFFFF), 16)).bitwiseAND(_LOW)


def noise_multiplier(seed: Column, edge: Column, sigma: float) -> Column:
    """1 + sigma * u with u in [-1, 1) from 32-bit multiplicative hashing of (seed, edge).

    Fixed values: the multipliers 2654435761 and 0x9E3779B9.
    """
    h = _times32(seed.cast("long").bitwiseAND(_LOW).bitwiseXOR(_times32(edge.cast("long").bitwiseAND(_LOW), 2654435761)), 0x9E3779B9)
    signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return F.lit(1.0) + F.lit(sigma) * signed / F.lit(float(1 << 31))


def agent_seed(agent: Column) -> Column:
    """The 32-bit seed of an agent. The multiplier above and the constant 0xCA7F00D."""
    return _times32(agent.cast("long").bitwiseAND(_LOW), 2654435761).bitwiseXOR(F.lit(0xCA7F00D))


def edge_noise(agent: int, edges: np.ndarray) -> np.ndarray:
    """u in [-1, 1) of each edge (uint64) for an agent; the same hashing on arrays.

    Fixed values: the multipliers above and the constant 0xCA7F00D of an agent's seed.
    """
    low = np.uint64(_LOW)
    seed = np.uint64((0xCA7F00D ^ (agent * 2654435761)) & _LOW)
    h = ((seed ^ ((edges * np.uint64(2654435761)) & low)) * np.uint64(0x9E3779B9)) & low
    return h.astype(np.uint32).view(np.int32) / 2.0**31
