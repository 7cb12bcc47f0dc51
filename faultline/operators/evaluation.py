"""Evaluation of predictions: everything is derived from one count per (true, predicted) pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.audit import one_row


def pair_counts(df: DataFrame, true: str = "label", predicted: str = "predicted_label") -> DataFrame:
    return (
        df.filter(F.col(true).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(F.col(true).alias("true_label"), F.col(predicted).alias("predicted_label"))
        .agg(F.count("*").alias("n"))
    )


def accuracy(pairs: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0))
    return pairs.agg(F.round(right / F.sum("n"), 6).alias("accuracy"), F.sum("n").alias("rows"))


def per_class(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every class that occurs; a zero division gives 0."""
    hit = F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)
    # Each pair counts once for its true and once for its predicted class.
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("true_label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.cast("bigint").alias("tp")),
                F.struct(F.col("predicted_label").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("tp")),
            )
        )
    )
    totals = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return totals.select(
        "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "tp"
    )


def classification_report(pairs: DataFrame) -> DataFrame:
    """Class rows and the accuracy, macro and weighted average rows."""
    classes = per_class(pairs)
    support = F.col("support")
    scores = ("precision", "recall", "f1")
    summary = classes.agg(
        F.sum("support").alias("rows"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[(F.sum(F.col(s) * support) / F.sum(support)).alias(f"weighted_{s}") for s in scores],
    )

    def row(name: str, columns: list[str]):
        values = [F.round(F.col(c), 6).alias(s) for s, c in zip(scores, columns)]
        return F.struct(F.lit(name).alias("class"), *values, F.col("rows").alias("support"))

    extra = summary.select(
        F.inline(
            F.array(
                row("accuracy", ["accuracy"] * 3),
                row("macro avg", [f"macro_{s}" for s in scores]),
                row("weighted avg", [f"weighted_{s}" for s in scores]),
            )
        )
    )
    rounded = classes.select("class", *[F.round(s, 6).alias(s) for s in scores], "support")
    return rounded.unionByName(extra)


def weighted_f1(pairs: DataFrame) -> float:
    scored = per_class(pairs).agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))
    return float(scored.first()["f1"])


def confusion_shares(pairs: DataFrame) -> DataFrame:
    """Counts and shares within the true class."""
    total = F.greatest(F.sum("n").over(Window.partitionBy("true_label")), F.lit(1))
    return pairs.withColumn("share", F.round(F.col("n") / total, 6))


def confusion_matrix(pairs: DataFrame, groups: int = 16) -> DataFrame:
    """Every pair of classes, zero cells included.

    The predicted classes lie in hash groups and every true class is sent to each group, so the
    grid is made by an equi-join in as many tasks as there are groups.
    """
    names = pairs.select(F.explode(F.array("true_label", "predicted_label")).alias("c")).distinct()
    rows = names.select(F.col("c").alias("true_label"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"))
    columns = names.select(F.col("c").alias("predicted_label"), F.pmod(F.hash("c"), F.lit(groups)).alias("_group"))
    grid = rows.join(columns, "_group").drop("_group")
    dense = grid.join(pairs, ["true_label", "predicted_label"], "left")
    return confusion_shares(dense.withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))


def top_support(pairs: DataFrame, top: int = 10) -> DataFrame:
    return per_class(pairs).select("class", "support").orderBy(F.desc("support"), "class").limit(top)


def metrics(pairs: DataFrame) -> DataFrame:
    """Accuracy, number of classes and test rows in one row."""
    return one_row(accuracy(pairs), per_class(pairs).agg(F.count("*").alias("n_classes")))
