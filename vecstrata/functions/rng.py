"""SplitMix64 in numpy: whole blocks of streams at once.

The generator and its constants are those published by Steele, Lea and Flood.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
# Fixed values of SplitMix64.
GAMMA, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(state: np.ndarray) -> np.ndarray:
    z = (state ^ (state >> U64(30))) * U64(MIX1)
    z = (z ^ (z >> U64(27))) * U64(MIX2)
    return z ^ (z >> U64(31))


def _u64(seed: int) -> np.ndarray:
    return np.array([seed % 2**64], U64)


def splitmix64(seed: int, count: int, first: int = 0) -> np.ndarray:
    """Outputs number first to first + count - 1 of the stream of a seed."""
    return outputs(_u64(seed), np.arange(first, first + count))[0]


def outputs(states: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Outputs number `at` of the streams that start in `states`, a row per stream."""
    return mixed(states[:, None] + (at.astype(U64) + U64(1)) * U64(GAMMA))


def substream(seed: int, index: np.ndarray) -> np.ndarray:
    """Starting states of the streams of a seed's indices."""
    return mixed((_u64(seed) ^ (index.astype(U64) * U64(GAMMA))) + U64(GAMMA))


def uniform(bits: np.ndarray) -> np.ndarray:
    """Doubles in [0, 1) of 53 bits."""
    return (bits >> U64(11)).astype(np.float64) * 2.0**-53


def bounded(bits: np.ndarray, n: int) -> np.ndarray:
    """Integers below n: the high half of bits * n."""
    high, low = bits >> U64(32), bits & U64(0xFFFFFFFF)
    n_high, n_low = U64(n >> 32), U64(n & 0xFFFFFFFF)
    middle = ((low * n_low) >> U64(32)) + high * n_low
    carried = (middle & U64(0xFFFFFFFF)) + low * n_high
    return high * n_high + (middle >> U64(32)) + (carried >> U64(32))


def gaussian(bits: np.ndarray) -> np.ndarray:
    """Standard normals by Box and Muller, two from each two neighbouring outputs."""
    u = uniform(bits)
    r = np.sqrt(-2.0 * np.log(1.0 - u[:, 0::2]))
    angle = 2.0 * np.pi * u[:, 1::2]
    return np.stack([r * np.cos(angle), r * np.sin(angle)], axis=2).reshape(len(bits), -1)
