"""Resampling weights that any engine can work out again.

How often a unit counts in a replicate is a Poisson count of mean one, read off a hash of (seed, unit key) and the replicate's number. So the
weight is known wherever the unit lies: nothing is drawn in one place, and sets that share units share their draws.
"""

from __future__ import annotations

import math

import numpy as np

BITS = 60
_MASK = (1 << BITS) - 1
_STEP, _FIRST, _SECOND = 0x9E3779B97F4A7C1, 0xBF58476D1CE4E5B, 0x94D049BB133111B
#: A hash below the k-th bound gives fewer than k + 1.
BOUNDS = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * (1 << BITS)) for k in range(16)]


def weights(keys: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """(keys, replicates) counts; ``keys`` are hashes of BITS bits. Replicate -1 counts every unit once."""
    mask = np.uint64(_MASK)
    x = (keys.astype(np.uint64)[:, None] + replicates.astype(np.uint64)[None, :] * np.uint64(_STEP)) & mask
    x = ((x ^ (x >> np.uint64(31))) * np.uint64(_FIRST)) & mask
    x = ((x ^ (x >> np.uint64(29))) * np.uint64(_SECOND)) & mask
    x ^= x >> np.uint64(32)
    counts = np.zeros(x.shape, np.int8)
    for bound in BOUNDS:
        above = x >= np.uint64(bound)
        if not above.any():
            break
        counts += above
    counts[:, replicates < 0] = 1
    return counts


def sql_weights(rows: str, key: str, resamples: int) -> str:
    """The same in SQL: ``rows`` (a table or query in brackets) once for each replicate 0, 1, ... as r with its count as w, and once as r = -1."""
    def mixed(shift: int, factor: int) -> str:
        return f"((xor(__x, __x >> {shift})::HUGEINT * {factor}) & {_MASK}::HUGEINT)::BIGINT"

    steps = f"SELECT *, (({key})::HUGEINT + r::HUGEINT * {_STEP} & {_MASK}::HUGEINT)::BIGINT AS __x FROM {rows}, range({resamples}) t(r)"
    for shift, factor in ((31, _FIRST), (29, _SECOND)):
        steps = f"SELECT * REPLACE ({mixed(shift, factor)} AS __x) FROM ({steps})"
    counts = " ".join(f"WHEN __x < {b} THEN {k}" for k, b in enumerate(BOUNDS))
    return (f"SELECT * EXCLUDE (__x), CASE {counts} ELSE {len(BOUNDS)} END AS w FROM (SELECT * REPLACE (xor(__x, __x >> 32) AS __x) FROM ({steps})) "
            f"UNION ALL SELECT *, -1 AS r, 1 AS w FROM {rows}")
