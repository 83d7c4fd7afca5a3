"""Sharding by a permutation-filled lookup table (Maglev hashing, Eisenbud et al., 2016).

Every shard prefers the slots of a table, whose size is prime, in an order of its own: an
offset and a step from two hashes of its name. Shards take turns, each claiming its most
preferred slot that is still free, until the table is full; so shards own equal shares, up
to one slot, and losing a shard moves few slots of the others. A document's slot is a hash
of its key modulo the table's size: placement is one lookup in a broadcast table of bounded
size, and neither the documents nor any key are shuffled.

The table is a plan parameter: it depends on the shard names only, never on data.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import named, table

#: A prime about a thousand times the number of shards: shares differ by 0.1 % at most.
SLOTS, SHARDS = 65_537, tuple(f"shard-{k:03d}" for k in range(64))
#: Largest table that is broadcast: 16 bytes a slot are then 16 MB.
MOST_SLOTS = 1_000_003


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: tuple[str, ...], slots: int) -> list[int]:
    """The shard (its place in shards) that owns each slot."""
    if not shards or len(set(shards)) < len(shards) or slots < len(shards) or slots > MOST_SLOTS:
        raise ValueError("shards must be distinct, and as many slots at least, at most MOST_SLOTS")
    if any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)) or slots < 2:
        raise ValueError("the number of slots must be prime")
    at = [_hash(f"{s}/offset") % slots for s in shards]
    step = [_hash(f"{s}/step") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def table_rows(spark: SparkSession, shards: tuple[str, ...], slots: int) -> DataFrame:
    """(slot int, shard string), made by SQL functions from the table's text; no Python runs on executors."""
    owners, names = ",".join(map(str, lookup_table(shards, slots))), F.array(*map(F.lit, shards))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return rows.select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(key: F.Column, slots: int) -> F.Column:
    """Slot of a key: the first 60 bits of the md5 of its text, modulo the table's size."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard) for each row of docs, equal keys in one shard.

    A null key gets slot 0. Repeated rows come back once each; other columns are left out,
    whatever their names; a key named slot or shard comes back as key_slot or key_shard. An
    empty table gives an empty one. Texts aren't read, whatever their length.
    """
    called = f"key_{key}" if key.lower() in ("slot", "shard") else key
    placed = docs.select(named(key).alias(called), F.coalesce(slot_of(named(key), slots), F.lit(0)).alias("slot"))
    return placed.join(F.broadcast(table_rows(docs.sparkSession, shards, slots)), "slot").select(named(called), "slot", "shard")


def op5_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"))


def oracle_sql(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> str:
    """The same placement in DuckDB, with the table as a literal; a test fills the table by brute force."""
    owners = ",".join(map(str, lookup_table(shards, slots)))
    names = ",".join(f"'{s}'" for s in shards)
    slot = f"COALESCE((('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT % {slots})::INT, 0)"
    return f"WITH t AS (SELECT [{owners}] AS owner, [{names}] AS name) SELECT doc_id, slot, name[owner[slot + 1] + 1] AS shard FROM (SELECT doc_id, {slot} AS slot FROM documents) d, t"
