"""Exact stratified splits and folds without sorting a label's rows in one task.

Rows are ordered inside their label by a hash of the id. A count per (label, hash prefix) finds
the one prefix each cut falls into; only the rows of that prefix, one in 65,536 of the label, are
ranked to find the hash the cut lies at. The table itself is then split row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import schema
from faultline.session import materialise

PREFIX_CHARS = 4


def hash_key(id_col: str, seed: int = schema.SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_parts(
    df: DataFrame,
    cuts: Sequence[Column],
    label: str = "label",
    id_col: str = "incident_id",
    seed: int = schema.SEED,
    out: str = "part",
) -> DataFrame:
    """Number each row's part: how many cuts lie before it in its label's hash order.

    A cut is a rank computed from `n`, the label's row count. Rows without label are left out.
    """
    rows = df.filter(F.col(label).isNotNull())
    hashed = rows.select(label, hash_key(id_col, seed).alias("_h")).withColumn("_prefix", F.left("_h", F.lit(PREFIX_CHARS)))
    counts = hashed.groupBy(label, "_prefix").agg(F.count("*").alias("_n"))
    in_label = Window.partitionBy(label)
    cumulated = counts.select(
        label,
        "_prefix",
        F.sum("_n").over(in_label.orderBy("_prefix")).alias("_upto"),
        (F.sum("_n").over(in_label.orderBy("_prefix")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(in_label).alias("n"),
    )
    ranks = F.array(
        *[F.struct(F.lit(i).alias("_cut"), cut.cast("bigint").alias("_rank")) for i, cut in enumerate(cuts)]
    )
    at_cut = (
        cumulated.select(label, "_prefix", "_before", "_upto", F.inline(ranks))
        .filter("_rank > _before and _rank <= _upto")
        .select(label, "_prefix", "_cut", (F.col("_rank") - F.col("_before")).alias("_within"))
    )
    at_cut = materialise(at_cut, "split-cuts")
    order = Window.partitionBy(label, "_cut").orderBy("_h")
    ranked = hashed.join(at_cut, [label, "_prefix"]).withColumn("_rn", F.row_number().over(order))
    thresholds = (
        ranked.filter("_rn = _within")
        .groupBy(label)
        .agg(*[F.max(F.when(F.col("_cut") == i, F.col("_h"))).alias(f"_t{i}") for i in range(len(cuts))])
    )
    thresholds = materialise(thresholds, "split-thresholds")
    key = hash_key(id_col, seed)
    passed = [F.when(key > F.coalesce(f"_t{i}", F.lit("")), 1).otherwise(0) for i in range(len(cuts))]
    part = sum(passed[1:], passed[0])
    return (
        rows.join(thresholds, label, "left")
        .withColumn(out, part)
        .select(*df.columns, out)
    )


def train_test(
    df: DataFrame, test_share: float = schema.TEST_SHARE, label: str = "label", id_col: str = "incident_id"
) -> DataFrame:
    """Add `split`: `test` for the given share of every label, else `train`."""
    parts = stratified_parts(df, [F.round(F.lit(test_share) * F.col("n"))], label, id_col)
    return parts.withColumn("split", F.when(F.col("part") == 0, "test").otherwise("train")).drop("part")


def folds(
    df: DataFrame, count: int = schema.CV_FOLDS, label: str = "label", id_col: str = "incident_id"
) -> DataFrame:
    """Add `fold` 0..count-1, every label spread evenly."""
    cuts = [F.round(F.col("n") * i / count) for i in range(1, count)]
    return stratified_parts(df, cuts, label, id_col, seed=schema.SEED + 1, out="fold")


def hash_sample(df: DataFrame, n: int, id_col: str = "incident_id", seed: int = schema.SEED) -> DataFrame:
    """n rows in hash order of their id: a repeatable sample without replacement."""
    return df.withColumn("_h", hash_key(id_col, seed)).orderBy("_h").limit(n).drop("_h")
