"""Keys that hold a large part of all rows, dealt over several parts so that no task of a join gets them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more rows has parts of about so many; the table of such keys goes to every task up to so many keys.
PART_ROWS, BROADCAST_KEYS = 50_000, 100_000


def spread(rows: DataFrame, key: str, by: list[str], part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows with ``part``, hubs (key, parts)). Rows of a hub, a key of more than ``part_rows`` rows, are dealt over its
    parts by the hash of ``by``; all others have part 0. Counting adds up before it shuffles, so a hub is as much work
    as any key."""
    hubs = hubs_of(rows, key, part_rows)
    return with_parts(rows, key, hubs, by), hubs


def hubs_of(rows: DataFrame, key: str, part_rows: int = PART_ROWS) -> DataFrame:
    """(key, parts) of keys of more than ``part_rows`` rows."""
    return rows.groupBy(key).agg(F.ceil(F.count("*") / part_rows).alias("parts")).where("parts > 1")


def with_parts(rows: DataFrame, key: str, hubs: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``part`` by the table of hubs, which may have been written before."""
    small = hubs.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    dealt = rows.join(F.broadcast(hubs) if small else hubs, key, "left")
    return dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("parts")), F.lit(0)).cast("long")).drop("parts")


def to_parts(rows: DataFrame, key: str, hubs: DataFrame, hub_key: str) -> DataFrame:
    """``rows`` once for every part of their key, with ``part``: the other side of a join on key and part."""
    joined = rows.join(hubs.select(F.col(hub_key).alias(key), "parts"), key, "left")
    return joined.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")
