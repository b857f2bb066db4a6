"""Shard placement by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime
size; the shards take turns, each claiming its first slot that is still free,
until the table is full (a shard of weight w has w turns a round).  Loads
differ by a turn at most, and adding or removing a shard moves few keys.  The table
has ``slots`` rows whatever the data, so it is broadcast, and a key's shard is
one lookup.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SLOTS = 65537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> np.ndarray:
    """Slot -> number of the shard in ``shards``."""
    if not _is_prime(slots):
        raise ValueError("the number of slots must be a prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and no more than there are slots")
    weights = weights or {}
    if any(weights.get(s, 1) < 1 for s in shards):
        raise ValueError("weights must be 1 or more")
    offset = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    turn = [0] * len(shards)
    table = np.full(slots, -1, np.int64)
    left = slots
    while left:
        for i, name in enumerate(shards):
            for _ in range(weights.get(name, 1)):
                if not left:
                    break
                while True:
                    slot = (offset[i] + turn[i] * skip[i]) % slots
                    turn[i] += 1
                    if table[slot] < 0:
                        break
                table[slot] = i
                left -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 15 hexadecimal digits of the md5 of its text, modulo the table size."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint") % F.lit(slots)


def place(df: DataFrame, shards: list[str], key_col: str = "doc_id", slots: int = SLOTS,
          weights: dict[str, int] | None = None) -> DataFrame:
    """The key column (as ``doc_id``), slot and shard for every row.

    A null key is placed like the empty string.  Equal keys share a shard.
    No shuffle: the table is the broadcast side of a join on the slot.
    """
    table = fill(shards, slots, weights)
    rows = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], "at bigint, shard string")
    keys = df.select(df[key_col].alias("doc_id"), slot_of(F.coalesce(df[key_col].cast("string"), F.lit("")), slots).alias("slot"))
    return keys.join(F.broadcast(rows), F.col("slot") == F.col("at")).select("doc_id", "slot", "shard")
