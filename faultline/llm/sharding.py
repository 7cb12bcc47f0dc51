"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

A record's slot is a hash of what it holds and never changes. The map says which shard a slot lies
in; it is made from the bytes of the slots, and rebalancing edits it and writes the next version.

Defined results: a null text counts as no bytes; a null doc_id is hashed like a value; rows that
are equal in every way are told apart by a copy number, so a row repeated without end is spread
over all slots; an empty table gives no rows and a map of equal slot counts; other columns are
ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.session import materialise, read_latest, write_version

SLOTS = 4096
SHARDS = 16
# A map is edited until no shard is this much over the mean.
TOLERANCE = 0.01


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy and virtual_slot of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # Equal rows are counted before they are dealt out, then numbered.
    return (
        rows.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("copies"))
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "copy"), F.lit(slots)).cast("int"))
        .drop("copies")
    )


def slot_sizes(rows: DataFrame) -> dict[int, int]:
    """Bytes of each slot in use; there are at most as many as the slot parameter says."""
    return {r["virtual_slot"]: r["size"] for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size")).collect()}


def balanced_map(sizes: dict[int, int], slots: int, shards: int) -> list[int]:
    """Shard of each slot: the largest slot first, each to the shard with the fewest bytes (then slots)."""
    heap = [(0, 0, shard) for shard in range(shards)]
    shard_of = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        size, held, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (size + sizes.get(slot, 0), held + 1, shard))
    return shard_of


def edited_map(
    shard_of: list[int], sizes: dict[int, int], shards: int, tolerance: float = TOLERANCE
) -> list[int]:
    """The map with as few slots moved as it takes: from the fullest shard to the emptiest, largest fitting slot first.

    Shards beyond `shards` are emptied; new ones start empty. It ends when no shard is `tolerance`
    above the mean or no move helps.
    """
    edited = list(shard_of)
    held: list[dict[int, int]] = [{} for _ in range(max(shards, max(shard_of, default=0) + 1))]
    for slot, shard in enumerate(edited):
        held[shard][slot] = sizes.get(slot, 0)
    total = [sum(slots.values()) for slots in held]

    def move(slot: int, source: int, target: int) -> None:
        size = held[source].pop(slot)
        held[target][slot] = size
        total[source] -= size
        total[target] += size
        edited[slot] = target

    for gone in range(shards, len(held)):
        for slot in sorted(held[gone], key=lambda s: (-held[gone][s], s)):
            move(slot, gone, min(range(shards), key=lambda t: (total[t], t)))
    mean = sum(total[:shards]) / shards
    while True:
        source = max(range(shards), key=lambda s: (total[s], -s))
        target = min(range(shards), key=lambda s: (total[s], s))
        if total[source] <= mean * (1 + tolerance):
            return edited
        gap = total[source] - total[target]
        fitting = [(size, -slot) for slot, size in held[source].items() if 0 < size < gap]
        if not fitting:
            return edited
        # no more than levels the two
        level = [x for x in fitting if x[0] <= gap / 2] or [min(fitting)]
        move(-max(level)[1], source, target)


def store_map(spark: SparkSession, path: str, shard_of: list[int]) -> None:
    """Write the map as the next version below `path`; earlier versions stay readable."""
    rows = [(slot, shard) for slot, shard in enumerate(shard_of)]
    write_version(spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1), path)


def read_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version: one row per slot, so its size is fixed by the slot parameter."""
    return read_latest(spark, path)


def assign(
    docs: DataFrame, map_path: str, slots: int = SLOTS, shards: int = SHARDS, grown_from: int | None = None
) -> DataFrame:
    """Every row with its shard and its place there (`slot`, gapless from 0).

    The stored map is used and, where its shards have grown uneven or their number has changed,
    edited; without one a balanced map is made and stored as the first version. `grown_from` makes
    that first map for another number of shards, so that the one used is an edit of it.
    """
    spark = docs.sparkSession
    rows = materialise(with_slots(docs, slots), "slotted")
    sizes = slot_sizes(rows)
    if read_map(spark, map_path) is None:
        store_map(spark, map_path, balanced_map(sizes, slots, grown_from or shards))
        edit = grown_from not in (None, shards)
    else:
        edit = True
    if edit:
        before = [r["shard"] for r in read_map(spark, map_path).orderBy("virtual_slot").collect()]
        shard_of = edited_map(before, sizes, shards)
        if shard_of != before:
            store_map(spark, map_path, shard_of)
    # A place is the rows of the shard's earlier slots and the rank within the slot: no window
    # ever spans a shard. The side joined has one row per slot.
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(
        F.broadcast(read_map(spark, map_path)), "virtual_slot"
    )
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")
    return (
        rows.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(first), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
        )
    )
