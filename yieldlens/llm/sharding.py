"""Sharding by a permutation-filled lookup table (DataFrame functions only).

Every shard has a preference order over a prime number of slots (an offset and a skip from
digests of its name); the shards take turns and each claims its first free slot until all are
taken. A row's slot is the digest of its key modulo the table size; the table (``slots``
rows, at most ``MAX_SLOTS``, a parameter and not a property of the data) is broadcast, so
placement is one map-side lookup. Shares differ by one slot at most, and adding or
removing a shard moves few of the other shards' slots.

Edge cases: null keys share the slot of the empty string; repeated keys share a shard;
other columns, also ones named slot or shard, are replaced only where the names clash.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

MAX_SLOTS = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int) -> list[int]:
    """Shard number of every slot."""
    if not shards or not is_prime(slots) or slots > MAX_SLOTS or slots < len(shards):
        raise ValueError("slots must be a prime, at least the number of shards and at most MAX_SLOTS")
    digest = [md5(s.encode()).hexdigest() for s in shards]
    at = [int(d[:8], 16) % slots for d in digest]
    skip = [int(d[8:16], 16) % (slots - 1) + 1 for d in digest]
    out, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while out[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            out[at[k]] = k
            free -= 1
            if not free:
                break
    return out


def slot_of(key: Column, slots: int) -> Column:
    """First 32 bits of the key's digest modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots).cast("long")).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], slots: int) -> DataFrame:
    """``rows`` plus slot and shard (the shard's name)."""
    filled = fill_table(shards, slots)
    lookup = rows.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(filled)], "slot int, shard string")
    return rows.drop("shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(lookup), "slot")


SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(64)], 6421


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard: 64 shards, 6,421 slots (the first prime over 100 a shard)."""
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS).select("doc_id", "slot", "shard")


def op2_sql() -> str:
    """The same for DuckDB, with the filled table as a list."""
    filled = ", ".join(map(str, fill_table(SHARDS, SLOTS)))
    names = ", ".join(f"'{s}'" for s in SHARDS)
    slot = f"(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {SLOTS})::INTEGER"
    return f"SELECT doc_id, slot, ([{names}])[([{filled}])[slot + 1] + 1] AS shard FROM (SELECT doc_id, {slot} AS slot FROM documents)"


OP2_SQL = op2_sql()
