"""The ledger of handled incidents: which keys the monitor has seen, in slots of their hash.

Layout below the monitor's root:

    claims/feed=<feed>/batch=<n>/slot=<s>   keys a batch took on
    ledger/segment=<id>/slot=<s>            keys of older batches, merged

A batch opens the slots of its own keys only. It looks its keys up and enters the new ones under one lock, so
of two feeds that hold a key at the same time one takes it on; all feeds of a root run in one driver. Claims are
merged into segments, and segments into one, after every MERGE_AFTER of them, so a long run lists few files.

A batch that is run again replaces its claims and ignores its former and later ones. The newest batch of a feed,
the only one that can be run again, is never merged.
"""

from __future__ import annotations

import threading
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import delete_folder, materialise, path_exists, subfolders

SLOTS = 256
MERGE_AFTER = 64
KEYS = "key string, slot int"

_locks: dict[str, threading.RLock] = defaultdict(threading.RLock)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def _read(spark: SparkSession, folder: str, layout: str) -> DataFrame:
    if not path_exists(spark, folder):
        return spark.createDataFrame([], layout)
    return spark.read.schema(layout).parquet(folder)


def known_keys(spark: SparkSession, root: str, slots: list[int], feed: str, batch_id: int) -> DataFrame:
    """Keys in some slots that other batches took on, or earlier ones of the same feed."""
    claims = _read(spark, f"{root}/claims", f"{KEYS}, feed string, batch bigint")
    others = claims.filter((F.col("feed") != feed) | (F.col("batch") < batch_id))
    merged = _read(spark, f"{root}/ledger", f"{KEYS}, segment string")
    wanted = F.col("slot").isin(slots)
    return others.filter(wanted).select("key").unionByName(merged.filter(wanted).select("key"))


def unseen(incidents: DataFrame, seen: DataFrame) -> DataFrame:
    """Incidents whose key is not in the ledger.

    The ledger outgrows a batch, so it is reduced to the batch's keys first. These are written, so that
    few of them go to the incidents and the texts stay where they lie.
    """
    known = seen.select("key").join(incidents.select("key"), "key", "left_semi").distinct()
    return incidents.join(materialise(known, "known-keys"), "key", "left_anti")


def claim(incidents: DataFrame, root: str, feed: str, batch_id: int) -> DataFrame:
    """Incidents of a batch (written tables, one row per key) that no other batch took on; now this one has."""
    spark = incidents.sparkSession
    placed = incidents.withColumn("slot", slot_of(F.col("key")))
    slots = [r["slot"] for r in placed.select("slot").distinct().collect()]  # SLOTS numbers at most
    with _locks[root]:
        # What was known by now is written, so the frame stays the same after the new keys are entered.
        new = unseen(placed, known_keys(spark, root, slots, feed, batch_id))
        keys = new.select("key", "slot").repartition("slot")
        keys.write.mode("overwrite").partitionBy("slot").parquet(f"{root}/claims/feed={feed}/batch={batch_id}")
    return new.drop("slot")


def _merge(spark: SparkSession, root: str, base: str, folders: list[str]) -> None:
    """Write the keys of some folders as one segment, then remove them; a key may be in both meanwhile."""
    read = spark.read.schema(KEYS).option("basePath", f"{root}/{base}").parquet(*folders)
    keys = read.select("key", "slot").distinct().repartition("slot")
    keys.write.partitionBy("slot").parquet(f"{root}/ledger/segment={uuid.uuid4().hex}")
    for folder in folders:
        delete_folder(spark, folder)


def compact(spark: SparkSession, root: str, merge_after: int = MERGE_AFTER) -> None:
    """Merge claims, all but the newest of each feed, and segments, where there are many."""
    with _locks[root]:
        old = []
        for feed in subfolders(spark, f"{root}/claims", "feed="):
            batches = subfolders(spark, feed, "batch=")
            old += sorted(batches, key=lambda folder: int(folder.rsplit("=", 1)[1]))[:-1]
        if len(old) >= merge_after:
            _merge(spark, root, "claims", old)
        segments = subfolders(spark, f"{root}/ledger", "segment=")
        if len(segments) >= merge_after:
            _merge(spark, root, "ledger", segments)
