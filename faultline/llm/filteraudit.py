"""Interaction audit of filters: what each removes at each place of every order, by wide packed counters.

Five filters judge every whole text once; their failures are a five-bit mask. A mask stands for one
big integer whose 64-bit fields hold the outcomes of all 600 steps (120 orders of five filters), four
outcomes a step. Masks are counted per part; a part's integers, times their counts, add up to one
integer, and its fields are the answer. No field can run over: none exceeds the part's rows.

Defined results: a null text is an empty one, and empty texts equal each other; a null lang is the
part '', as an empty one is; a row without an id is never a copy and no row is a copy of it; repeated
rows count one by one and are no copies of each other; a document is good or toxic if any label row of
its id says so; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.session import materialise

BREAKS = r"[\x20\x09-\x0D]+"
CAPITALS = "[A-Z]"
SIGNS = r"[#$%&*|]"
LEAST_WORDS = 100
LEAST_DISTINCT = 80
MOST_CAPITALS = 10
LETTERS = "ABCDE"
COPY = "E"

OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that need nothing but the text: true where it fails."""
    words = F.filter(F.split(text, BREAKS), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * F.regexp_count(text, F.lit(CAPITALS)) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SIGNS),
    }


def bit(letter: str, letters: str = LETTERS) -> int:
    return 1 << letters.index(letter)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, n_good, n_toxic: the documents of each part by the filters they fail."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = functools.reduce(
        Column.__add__, [F.when(failed, bit(name)).otherwise(0) for name, failed in text_failures(F.col("text")).items()]
    )
    judged = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            text.alias("text"),
        )
        .select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
        # repeated rows are one from here on
        .groupBy("doc_id", "part", "mask", "digest")
        .agg(F.count("*").alias("n"))
    )
    judged = materialise(judged, "audit-rows")
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("marked_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # both sides are written out: small labels are broadcast by their size, a hot id is split by AQE
    marked = materialise(marked.filter("good = 1 or toxic = 1"), "audit-labels")
    known = judged.filter("doc_id is not null").join(marked, F.col("doc_id") == F.col("marked_id"), "left")
    flags = [F.coalesce(name, F.lit(0)).alias(name) for name in ("good", "toxic")]
    known = known.select("doc_id", "part", "mask", "digest", "n", *flags)
    nameless = judged.filter("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    # Per text a row for each part and flag, however many copies there are; its least id may be the first.
    groups = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least")
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("first", F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    copies = groups.select(
        "part", (F.col("mask") + bit(COPY)).alias("mask"), (F.col("n") - F.col("first")).alias("n"), "good", "toxic"
    )
    firsts = groups.select("part", "mask", F.col("first").alias("n"), "good", "toxic")
    every = copies.unionByName(firsts).unionByName(nameless)
    return (
        every.groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("good")).alias("n_good"),
            F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"),
        )
        .filter("n > 0")
    )


@functools.cache
def steps(letters: str) -> tuple[tuple[str, int], ...]:
    """(order, step) of every field, in the order of the fields."""
    orders = ("".join(order) for order in itertools.permutations(letters))
    return tuple((order, step) for order in orders for step in range(1, len(letters) + 1))


@functools.cache
def packed(mask: int, letters: str, outcome: str) -> int:
    """The big integer of a mask: field i is 1 where the outcome holds at step i."""
    fields = np.zeros(len(steps(letters)), dtype="<u8")
    for i, (order, step) in enumerate(steps(letters)):
        own = bit(order[step - 1], letters)
        earlier = any(mask & bit(name, letters) for name in order[: step - 1])
        fails = bool(mask & own)
        fields[i] = {
            "kept": not fails and not earlier,
            "removed": fails and not earlier,
            "redundant": fails and earlier,
            "unique_fails": mask == own,
        }[outcome]
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int, letters: str) -> np.ndarray:
    """The fields of a sum of big integers."""
    return np.frombuffer(total.to_bytes(8 * len(steps(letters)), "little"), dtype="<u8").astype(np.int64)


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row per part, order and step from mask counts; bit i of a mask is a failure of filter i of `letters`.

    A group has at most one row per mask, so no task holds more than 32 rows of a part at a time.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(map(int, r)) for r in zip(part["mask"], part["n"], part["n_good"], part["n_toxic"], strict=True)]
        out = {}
        for outcome in OUTCOMES:
            out[outcome] = unpacked(sum(n * packed(mask, letters, outcome) for mask, n, _, _ in rows), letters)
        out["good_lost"] = unpacked(sum(n * packed(mask, letters, "removed") for mask, _, n, _ in rows), letters)
        out["toxic_lost"] = unpacked(sum(n * packed(mask, letters, "removed") for mask, _, _, n in rows), letters)
        orders, places = zip(*steps(letters), strict=True)
        of = np.array([letters.index(order[step - 1]) for order, step in steps(letters)])
        removed = np.zeros(len(letters), dtype=np.int64)
        np.add.at(removed, of, out["removed"])
        head = {"part": part["part"].iloc[0], "filter_order": orders, "step": np.array(places, dtype=np.int32)}
        return pd.DataFrame({**head, **out, "shapley": removed[of]})

    return counts.groupBy("part").applyInPandas(run, SCHEMA)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole audit of `docs`: 600 rows for each part."""
    return audit(materialise(mask_counts(docs, labels), "audit-masks"))
