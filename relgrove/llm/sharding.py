"""Placement of rows on shards by a permutation-filled lookup table (operator 10, DataFrame functions only).

Each shard has a permutation of the slots of a table of prime size: a start
and a step, both hashed from its name. The shards take turns, and each claims
the first slot of its permutation that is still free, until the table is full;
so any two shards differ by one slot at most. A key is hashed to a slot, and
the slot's entry is its shard: one lookup in a table of ``table_size`` rows,
whose size never depends on the data and which is therefore broadcast. When a
shard leaves or joins, few other slots change hands.

Defined results: a null key is placed as the empty key; equal keys, repeated
rows included, get the same shard; with ``spread`` a hot key is placed by key
and row instead. An empty table gives an empty result. Columns of the input
pass through, whatever their names: where one is called ``slot`` or ``shard``,
the new column's name gets an underscore (``slot_``), or more of them.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgrove.llm.common import free_name

TABLE_SIZE = 65_537
SHARDS = 64


def _number(name: str) -> int:
    return int(md5(name.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


@lru_cache(maxsize=8)
def lookup_table(shards: tuple[str, ...], table_size: int = TABLE_SIZE) -> tuple[int, ...]:
    """The index of the shard that holds each slot."""
    if not is_prime(table_size) or len(shards) > table_size or not shards or len(set(shards)) < len(shards):
        raise ValueError("the table's size must be a prime, and there must be that many different shards at most and one at least")
    start = [_number(f"{s}/start") % table_size for s in shards]
    step = [_number(f"{s}/step") % (table_size - 1) + 1 if table_size > 2 else 1 for s in shards]
    owner, filled = [-1] * table_size, 0
    while True:
        for k in range(len(shards)):
            while owner[start[k]] >= 0:
                start[k] = (start[k] + step[k]) % table_size
            owner[start[k]] = k
            filled += 1
            if filled == table_size:
                return tuple(owner)


def shard_names(n: int) -> tuple[str, ...]:
    return tuple(f"shard-{k:05d}" for k in range(n))


def slot_of(key: Column, table_size: int = TABLE_SIZE) -> Column:
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(table_size)).cast("int")


def place(df: DataFrame, key: str, shards: int | tuple[str, ...] = SHARDS, table_size: int = TABLE_SIZE, spread: str | None = None) -> DataFrame:
    """``df`` with the columns slot (int) and shard (int, the shard's index), under free names if it has such columns.

    spread: name of a column by which keys that alone exceed a shard's even
    share are dealt over all shards.
    """
    slot, shard = free_name(df, "slot"), free_name(df, "shard")
    names = shard_names(shards) if isinstance(shards, int) else tuple(shards)
    owners = df.sparkSession.createDataFrame(list(enumerate(lookup_table(names, table_size))), f"{slot} int, {shard} int")
    if spread is None:
        return df.withColumn(slot, slot_of(F.col(key), table_size)).join(F.broadcast(owners), slot)
    hot, mine = free_name(df, "hot_key"), free_name(df, "own_key")
    counts = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias(hot)).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    # fewer keys than shards can exceed the even share, so this set is bounded by the number of shards
    hot_keys = [r[0] for r in counts.where(F.col("count") > total / len(names)).collect()]
    keyed = df.withColumn(mine, F.coalesce(F.col(key).cast("string"), F.lit("")))
    keyed = keyed.withColumn(mine, F.when(F.col(mine).isin(hot_keys), F.concat_ws("\x1f", mine, F.col(spread).cast("string"))).otherwise(F.col(mine)))
    return keyed.withColumn(slot, slot_of(F.col(mine), table_size)).drop(mine).join(F.broadcast(owners), slot)


def write_shards(placed: DataFrame, path: str, shard: str = "shard") -> None:
    """Writes a folder of Parquet files per shard; no shuffle, as each task keeps a file per shard open."""
    placed.write.partitionBy(shard).parquet(path)
