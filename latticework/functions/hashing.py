"""The rolling feature hash, in numpy for whole columns, and n-gram features over it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seed and factor of the hash, and seeds by feature order.
SEED0, FACTOR = 0x16F11FE89B0D677C, 0x6EED0E9DA4D94A4F
PATTERN_SEED = 0x7A11ED00000000
ORDER_SEEDS = {1: 0x5123A31421F, 2: 0x5123A68442F, 3: 0x51239AB41F1F}
#: Fixed value: the pattern of a node before the sentence.
BOS_PATTERN = 0x80000000


def mix(state: np.ndarray | np.uint64, data) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = (np.asarray(state, np.uint64) ^ np.asarray(data).astype(np.uint64, copy=False)) * np.uint64(FACTOR)
    return (v << np.uint64(32)) | (v >> np.uint64(32))


def mix_one(state: int, data: int) -> int:
    v = ((state ^ data) * FACTOR) & 0xFFFFFFFFFFFFFFFF
    return ((v << 32) | (v >> 32)) & 0xFFFFFFFFFFFFFFFF


#: Hash states of the n-gram features 0, 1 and 2, of one, two and three nodes, before their nodes.
PREFIXES = tuple(mix_one(mix_one(mix_one(SEED0, 2 + n), n - 1), ORDER_SEEDS[n]) for n in (1, 2, 3))


def ngram_hash(index: int, *nodes: np.ndarray) -> np.ndarray:
    """Hash of an n-gram feature, nodes being t0, t1, t2 as far as it reaches."""
    state = mix(mix(mix(np.uint64(SEED0), 2 + len(nodes)), index), ORDER_SEEDS[len(nodes)])
    for x in nodes:
        state = mix(state, x)
    return state


def pattern_hash(index: int, *features: np.ndarray) -> np.ndarray:
    """Hash of a pattern of primitive features of one node."""
    state = mix(mix(mix(np.uint64(SEED0), index), len(features)), PATTERN_SEED)
    for x in features:
        state = mix(state, x)
    return state


def ngram_index(index: int, bits: int, *nodes: Column) -> Column:
    """The n-gram hash masked to `bits` bits, as a long."""

    @F.pandas_udf("long")
    def masked(*t: pd.Series) -> pd.Series:
        return pd.Series((ngram_hash(index, *(x.to_numpy(np.int64) for x in t)) & np.uint64((1 << bits) - 1)).astype(np.int64))

    return masked(*nodes)


def mix_sql(state: str, data: str) -> str:
    """DuckDB SQL of one step, for checks."""
    v = f"((xor({state}, ({data})::UBIGINT)::UHUGEINT * {FACTOR}::UHUGEINT) % 18446744073709551616)"
    return f"((({v} % 4294967296) * 4294967296 + {v} // 4294967296)::UBIGINT)"
