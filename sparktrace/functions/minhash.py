"""MinHash signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Prime modulus of the hash family h(t) = (a*t + b) mod P.
PRIME = 2_147_483_647
PERMUTATIONS = 128


def coefficients(permutations: int = PERMUTATIONS, seed: int = 1) -> list[tuple[int, int]]:
    """Multiplier and offset of each permutation, drawn from a linear congruential sequence."""
    drawn, state = [], seed
    for _ in range(permutations):
        pair = []
        for _ in range(2):
            state = (1103515245 * state + 12345) % 2**31
            pair.append(1 + state % (PRIME - 1))
        drawn.append((pair[0], pair[1]))
    return drawn


def token(pos: Column, value: Column) -> Column:
    """Integer token of one feature cell; the value must be a small count."""
    return F.pmod(pos.cast("bigint") * F.lit(1_000_003) + value.cast("bigint"), F.lit(PRIME))


def minhash(tokens: Column, permutations: int = PERMUTATIONS, seed: int = 1) -> Column:
    """Array with the minimum of every permutation over the token set; missing numbers where there is no token.

    Numpy hashes the different tokens of a batch, then takes the least of every row.
    """
    a, b = np.array(coefficients(permutations, seed), dtype=np.int64).reshape(permutations, 2).T

    def signed(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        present = ~flat.is_null().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(lists)), sizes)[present]
        some, at = np.unique(flat.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
        counts = np.bincount(row, minlength=len(lists))
        full, ends = np.flatnonzero(counts), np.cumsum(counts)
        made = np.zeros((len(lists), permutations), dtype=np.int64)
        for i in range(permutations):
            # Products stay below 2**62.
            hashed = (a[i] * (some % PRIME) + b[i]) % PRIME
            if len(full):
                made[full, i] = np.minimum.reduceat(hashed[at], (ends - counts)[full])
        values = pa.array(made.ravel(), mask=np.repeat(counts == 0, permutations))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * permutations), values)

    return F.arrow_udf(signed, "array<bigint>")(tokens)


def signature_similarity(left: Column, right: Column) -> Column:
    """Share of equal positions: the Jaccard estimate."""
    same = F.zip_with(left, right, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda total, x: total + x) / F.size(left)
