"""Placement of rows on shards through a permutation-filled lookup table.

Every shard owns a permutation of the slots of a prime-sized table, given by an offset and a skip. Shards take
turns; at its turn a shard claims the first slot of its permutation that is still free. Each shard ends with
``slots / shards`` slots, give or take one, and removing a shard moves few keys that were not its own. A key is
hashed to a slot, and the slot's owner is read from the table, which is broadcast: its size is ``slots`` rows
whatever the data hold (``slots`` is at most ``MAX_SLOTS``).

The fill is a loop over the slots on the driver; everything that touches rows is DataFrame expressions.

Null keys hash as the fixed marker below, so they land together on one known slot; an empty string is an
ordinary key. Repeated keys land on the same shard. Extra columns pass through untouched; columns of the input that are named like
the two outputs are replaced by them, even the key itself. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SLOTS = 1_048_573
NULL_KEY = "\u0000null"


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's permutation: slot number ``j`` of it is ``(offset + j * skip) % slots``."""
    digest = hashlib.md5(shard.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def fill_table(shards: list[str], slots: int, weights: list[int] | None = None) -> list[int]:
    """Owner (index into ``shards``) of every slot. A shard of weight w takes w turns in each round."""
    if not is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and no more than the slots")
    turns = [i for i, w in enumerate(weights or [1] * len(shards)) for _ in range(w)]
    if not turns or len(weights or shards) != len(shards):
        raise ValueError("weights must give each shard a number, not all of them 0")
    at = [preference(s, slots) for s in shards]
    nxt, skip = [o for o, _ in at], [k for _, k in at]
    owner, left = [-1] * slots, slots
    while True:
        for i in turns:
            slot = nxt[i]
            while owner[slot] >= 0:
                slot = (slot + skip[i]) % slots
            owner[slot] = i
            nxt[i] = (slot + skip[i]) % slots
            left -= 1
            if not left:
                return owner


def lookup_frame(spark: SparkSession, owner: list[int]) -> DataFrame:
    """The table as rows (slot, shard), from one folded literal: no Python serialisation on the executors."""
    cells = F.split(F.lit(",".join(map(str, owner))), ",")
    return spark.range(1).select(F.posexplode(cells).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def place(df: DataFrame, key: str, shards: list[str], slots: int, weights: list[int] | None = None, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard index of each row's key. No row moves: the join is a broadcast lookup."""
    if slot_name == shard_name:
        raise ValueError("slot and shard need two names")
    table = lookup_frame(df.sparkSession, fill_table(shards, slots, weights)).toDF(slot_name, shard_name)
    text = F.coalesce(F.col(key).cast("string"), F.lit(NULL_KEY))
    slot = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % F.lit(slots)
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (slot_name.lower(), shard_name.lower())]
    return df.select(slot.cast("int").alias(slot_name), *rest).join(F.broadcast(table), slot_name)
