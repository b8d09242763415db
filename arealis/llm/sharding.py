"""Reproducible shuffles and shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of given columns, so the numbers do not depend on how the input is cut into files or
tasks. A row's place in the shuffled order is ``permuted(number)``; its shard and slot follow by division. Anybody who
knows the row count and the seed can compute both ways without reading a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, without

ROUNDS = 6
FACTORS = (1_103_515_245, 1_664_525)  # odd, below 2^31: products of 31-bit numbers stay in a signed long
ROW_NUMBER, POSITION, SHARD, SLOT = "row_number", "position", "shard", "slot"


def round_keys(seed: int) -> list[int]:
    """28-bit key of each round."""
    return [int(hashlib.md5(f"{seed}:{r}".encode()).hexdigest()[:7], 16) for r in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of one half of the smallest even-width domain that holds ``n`` numbers."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _rounds(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in reversed(keys) if back else keys:
        side = left if back else right
        t = (side ^ key) * FACTORS[0] + key
        t = ((t ^ (t >> 15)) & 0x7FFFFFFF) * FACTORS[1]
        t = (t >> 13) & mask
        left, right = (right ^ t, left) if back else (right, left ^ t)
    return (left << bits) | right


def permuted(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """A permutation of ``0 .. n-1``: Feistel rounds, again and again until the number is below ``n``."""
    keys, bits = round_keys(seed), half_bits(n)
    if bits > 31:
        raise ValueError("more than 2^62 rows")
    out = np.array(x, np.int64)
    walking = np.arange(len(out))
    while len(walking):
        out[walking] = _rounds(out[walking], bits, keys, back)
        walking = walking[out[walking] >= n]
    return out


def position(number: Column, n: Column, seed: int) -> Column:
    """Place of a row number in the shuffled order of ``n`` rows."""
    @F.pandas_udf(T.LongType())
    def fn(x: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), int(total.iloc[0]), seed) if len(x) else x, dtype=np.int64)

    return fn(number, n)


def number_rows(df: DataFrame, order: list[str], total: str = "n_rows") -> DataFrame:
    """Add ``row_number`` (from 0, gapless, by ``order``) and the row count.

    Range partitions are numbered inside and then moved by the sizes of those before. Equal rows may change places,
    which nobody can see; their place in the input is the last range key, so that copies of one row fill many tasks.
    The only table that one task sees has a row per partition.
    """
    df = without(df, [ROW_NUMBER, total])
    keys = [F.col(f"`{c}`") for c in order]
    ranged = (df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, F.col("_tie"))
              .sortWithinPartitions(*keys, "_tie").drop("_tie"))
    placed = stored(ranged.withColumns({"_part": F.spark_partition_id(),
                                        "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(Window.partitionBy()).alias(total))
    # a row per partition of the shuffle above: bounded by its setting
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(ROW_NUMBER, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"))


def shard_rows(df: DataFrame, shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """Add ``row_number``, ``position`` in the shuffle, ``shard`` and gapless ``slot``; counts differ by one at most.

    ``order`` should tell rows apart; rows equal in it get neighbouring numbers. Nulls come first. Columns named like
    a result are replaced. Pass only the columns needed later: all of them are shuffled once and written once. An
    empty table gives an empty one.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    numbered = number_rows(without(df, [POSITION, SHARD, SLOT]), order)
    placed = numbered.withColumn(POSITION, position(F.col(ROW_NUMBER), F.col("n_rows"), seed)).drop("n_rows")
    return placed.withColumns({SHARD: (F.col(POSITION) % shards).cast("int"),
                               SLOT: F.floor(F.col(POSITION) / shards).cast("long")})
