"""Sharding by a permutation-filled lookup table.

Every shard prefers the table's slots in an order of its own, a permutation that
two hashes of its name give.  Shards take turns claiming their most preferred free
slot until the prime-sized table is full, so that each owns an even share (or a
share by weight) and few slots change hands when a shard comes or goes.  A row's
place is table[hash(key) mod size]: a look-up in an array literal, no shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, some hundred times the number of shards or more.
TABLE_SIZE = 65537


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> np.ndarray:
    """Number of the owning shard of each slot.  A shard of weight w claims w slots in its turn (1 unless given).

    Shards are taken in the order of their names, so that the list's order plays no part.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be named, each once")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime, not below the number of shards")
    turns = {s: (weights or {}).get(s, 1) for s in shards}
    if min(turns.values()) < 0 or not any(turns.values()):
        raise ValueError("weights must not be negative, nor all zero")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    offset = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    tried = [0] * len(shards)
    table = np.full(size, -1, dtype=np.int32)
    free = size
    while free:
        for i in order:
            for _ in range(turns[shards[i]]):
                while table[slot := (offset[i] + tried[i] * skip[i]) % size] >= 0:
                    tried[i] += 1
                table[slot] = i
                tried[i] += 1
                free -= 1
                if not free:
                    return table
    return table


def slot_of(key: Column, size: int) -> Column:
    """The first 60 bits of the MD5 of the key as text, mod size; a null key is the text ''."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size


def assign_shards(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """docs with two more columns: slot, and shard, the owner's name.

    Rows with equal keys share a shard; null keys are placed as the empty text.
    The table has `size` short entries whatever the data, so that every task can
    hold it.  Columns of those names that docs has are replaced.  No rows give no rows.
    """
    table = fill_table(shards, size, weights)
    owner = F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<int>")  # folded into one literal, which travels with the plan
    placed = docs.withColumn("slot", slot_of(F.col(key), size))
    names = F.array(*[F.lit(s) for s in shards])
    return placed.withColumn("shard", names[owner[F.col("slot").cast("int")]])


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 8, key: str = "doc_id") -> None:
    """One folder a shard.  Each shard's rows are dealt over several tasks by slot, so that no task writes a whole shard."""
    part = F.pmod(F.xxhash64("slot", key), F.lit(files_per_shard))
    placed.repartition("shard", part).write.partitionBy("shard").parquet(path)
