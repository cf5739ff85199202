"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a prime-sized table
(a start and a step, both hashed from its name). The shards take turns, each
claiming its next free slot, until the table is full. A key's slot is its hash
modulo the table's size; the broadcast table gives the shard. Adding or
removing a shard moves little besides that shard's own keys.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: A prime; the table has a row per slot, whatever the data: its size is this parameter.
TABLE_SIZE = 16381
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The index of the shard that holds each slot."""
    if not _is_prime(size) or not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("needs a prime table size, and different shards, no more than slots")
    start, step = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        start.append(int.from_bytes(digest[:8], "big") % size)
        step.append(int.from_bytes(digest[8:], "big") % (size - 1) + 1)
    table, at, left = [-1] * size, list(start), size
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """A key's slot; a null key has one of its own."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % size


def shard_documents(docs: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE, slot_into: str = "slot", shard_into: str = "shard") -> DataFrame:
    """``docs`` with the slot and the shard of each row's key.

    Rows with one key share a shard; null is a key like others. All rows and
    columns stay; existing columns of the two names are replaced.
    """
    spark, table = docs.sparkSession, lookup_table(shards, size)
    entries = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    at, index = unused("at", docs), unused("index", docs)
    places = spark.range(1).select(F.posexplode(entries).alias(at, index))
    names = F.element_at(F.array(*map(F.lit, shards)), F.col(index) + 1)
    rows = docs.withColumn(slot_into, slot(F.col(f"`{key}`"), size))
    placed = rows.join(F.broadcast(places), F.col(f"`{slot_into}`") == F.col(at))
    return placed.withColumn(shard_into, names).drop(at, index)


def oracle_sql(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> str:
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""
with k as (select doc_id, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 12) as bigint) % {size} slot from documents)
select doc_id, slot, [{names}][1 + [{",".join(map(str, lookup_table(shards, size)))}][1 + slot]] shard from k
"""
