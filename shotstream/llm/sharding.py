"""Placement by a permutation-filled lookup table.

Every shard walks its own permutation of the slots of a prime-sized table; shards take turns and claim
the next slot still free. Each gets its fair number of slots to within one, and adding or removing a
shard moves little more than its share. The table has a fixed number of slots, so its size is known.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotstream.llm.common import doc_key

SLOTS = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> np.ndarray:
    """Index of the shard that owns each slot. Shard order does not matter, only names do."""
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and no more than slots")
    turn = sorted(range(len(shards)), key=lambda i: shards[i])
    digests = {i: hashlib.sha256(shards[i].encode()).digest() for i in turn}
    offset = {i: int.from_bytes(d[:8]) % slots for i, d in digests.items()}
    skip = {i: int.from_bytes(d[8:16]) % (slots - 1) + 1 for i, d in digests.items()}
    owner, at, free = [-1] * slots, dict(offset), slots
    while True:
        for i in turn:
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + skip[i]) % slots
            owner[slot] = i
            at[i] = (slot + skip[i]) % slots
            free -= 1
            if not free:
                return np.array(owner)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its md5, modulo the table size."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint") % slots


def place(
    docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; one lookup per row in a broadcast table, no shuffle.

    A null key goes where the empty text goes. Equal keys share a shard. Columns of ``docs`` named
    slot or shard are replaced.
    """
    owners = docs.sparkSession.createDataFrame(
        [(slot, shards[i]) for slot, i in enumerate(lookup_table(shards, slots).tolist())],
        "__slot bigint, shard string",
    )
    rows = docs.drop("slot", "shard").withColumn("slot", slot_of(doc_key(key), slots))
    return rows.join(F.broadcast(owners), rows["slot"] == owners["__slot"]).drop("__slot")
