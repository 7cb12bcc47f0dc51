"""Counts, shares and audits over an incident table.

Label-level results start from one count per label, so the word-list scans and windows that
follow run on that small table. None of these needs rows of one label in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions import lexicon
from faultline.functions.risk import with_label_risk
from faultline.operators.cleaning import label_counts

SHORT_CHARS = 20


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def total_of(counts: DataFrame) -> Column:
    """Sum of `n` as a scalar subquery: no window that would move all groups to one task."""
    return counts.agg(F.sum("n")).scalar()


def domain_counts(df: DataFrame) -> DataFrame:
    return (
        df.filter("domain is not null").groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain")
    )


def narrative_stats(df: DataFrame) -> DataFrame:
    length = F.length("narrative")
    return df.agg(
        F.count("*").alias("total_reports"),
        F.min(length).cast("bigint").alias("min_length"),
        F.max(length).cast("bigint").alias("max_length"),
        F.round(F.avg(length), 6).alias("avg_length"),
        F.median(length).alias("median_length"),
    )


def dataset_stats(df: DataFrame) -> DataFrame:
    classes = label_counts(df).agg(F.count("*").alias("anomaly_classes"))
    return one_row(narrative_stats(df), classes)


def top_classes(df: DataFrame, top: int = 20) -> DataFrame:
    return label_counts(df).orderBy(F.desc("n"), "label").limit(top)


def class_shares(df: DataFrame) -> DataFrame:
    """Every label with its count and its share of all rows, rows without label included."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    share = F.col("n") / total_of(counts)
    return counts.withColumn("share", F.round(share, 6)).filter("label is not null")


def class_distribution(df: DataFrame, top: int = 16) -> DataFrame:
    return class_shares(df).orderBy(F.desc("n"), "label").limit(top)


def vocabulary_size(df: DataFrame) -> DataFrame:
    """Distinct space-separated words of all narratives; equal words of a row are sent on once."""
    words = df.select(F.explode(F.array_distinct(F.split(F.lower("narrative"), r"\s+"))).alias("word"))
    return words.agg(F.count_distinct("word").alias("vocabulary"))


def row_audit(df: DataFrame) -> DataFrame:
    """The audit's figures on rows and classes, without the word count."""
    length = F.length("narrative")
    # Repeats of a text beyond the first; a digest stands in for the text in the shuffle.
    repeats = F.count("narrative") - F.count_distinct(F.unhex(F.sha2("narrative", 256)))
    rows = df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("label").isNull()).alias("missing_labels"),
        F.count_if(F.col("narrative").isNull()).alias("missing_narratives"),
        F.count_if(length < SHORT_CHARS).alias("short_narratives"),
        F.min(length).cast("bigint").alias("min_length"),
        F.round(F.avg(length), 6).alias("avg_length"),
        F.max(length).cast("bigint").alias("max_length"),
        F.round(F.count_if(F.col("label") == schema.OTHER) / F.count("*"), 6).alias("other_share"),
        repeats.alias("duplicate_narratives"),
    )
    # Ties go by label: the first by (count desc, label) is the majority, the last the minority.
    classes = label_counts(df).agg(
        F.count("*").alias("classes"),
        F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("first"),
        F.max(F.struct((-F.col("n")).alias("n"), "label")).alias("last"),
    )
    extremes = classes.select(
        "classes",
        F.col("first.label").alias("majority_class"),
        (-F.col("first.n")).alias("majority_rows"),
        F.col("last.label").alias("minority_class"),
        (-F.col("last.n")).alias("minority_rows"),
        F.round(-F.col("first.n") / F.greatest(F.lit(1), -F.col("last.n")), 6).alias("imbalance"),
    )
    return one_row(rows, extremes)


def quality_audit(df: DataFrame) -> DataFrame:
    return one_row(row_audit(df), vocabulary_size(df))


def graded_audit(df: DataFrame) -> DataFrame:
    """The audit as (metric, value, status) rows."""

    def text(value: Column) -> Column:
        return value.cast("string")

    def graded(metric: str, value: Column, warn: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            value.alias("value"),
            F.when(warn, "WARN").otherwise("OK").alias("status"),
        )

    fine = F.lit(False)
    rows = [
        graded("Total rows", text(F.col("rows")), fine),
        graded("Columns", F.lit(", ".join(df.columns)), fine),
        graded("Missing labels", text(F.col("missing_labels")), F.col("missing_labels") > 0),
        graded("Missing narratives", text(F.col("missing_narratives")), F.col("missing_narratives") > 0),
        graded("Duplicate narratives", text(F.col("duplicate_narratives")), F.col("duplicate_narratives") > 0),
        graded(
            f"Very short narratives (<{SHORT_CHARS} chars)",
            text(F.col("short_narratives")),
            F.col("short_narratives") > 0,
        ),
        graded(
            "Class imbalance (majority/minority ratio)",
            F.concat(text(F.round("imbalance", 1)), F.lit("x")),
            F.col("imbalance") > 10,
        ),
        graded(
            "'Other' bucket coverage",
            F.concat(text(F.round(F.col("other_share") * 100, 1)), F.lit("%")),
            F.col("other_share") > 0.5,
        ),
        graded("Distinct classes", text(F.col("classes")), fine),
    ]
    return row_audit(df).select(F.inline(F.array(*rows)))


def label_risk_counts(df: DataFrame) -> DataFrame:
    """Label counts with the risk level of each label; rows without label count as medium."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    return with_label_risk(counts)


def criticality(df: DataFrame) -> DataFrame:
    """Rows and share of the three risk levels, a level without rows included."""
    levels = ("critical", "high", "medium")
    totals = label_risk_counts(df).agg(
        *[F.sum(F.when(F.col("risk_level") == level, F.col("n")).otherwise(0)).alias(level) for level in levels],
        F.sum("n").alias("total"),
    )
    rows = [
        F.struct(
            F.lit(level).alias("risk_level"),
            F.coalesce(level, F.lit(0)).cast("bigint").alias("n"),
            F.round(F.col(level) / F.col("total"), 6).alias("share"),
        )
        for level in levels
    ]
    return totals.select(F.inline(F.array(*rows)))


def top_critical_labels(df: DataFrame, top: int = 5) -> DataFrame:
    return (
        label_risk_counts(df)
        .filter("risk_level = 'critical' and label is not null")
        .select("label", "n")
        .orderBy(F.desc("n"), "label")
        .limit(top)
    )


def dominant_domains(df: DataFrame, top: int = 10) -> DataFrame:
    """For the most frequent labels: count and most frequent domain."""
    pairs = df.filter("label is not null").groupBy("label", "domain").agg(F.count("*").alias("pair_n"))
    best = pairs.groupBy("label").agg(
        F.sum("pair_n").alias("n"),
        F.min(
            F.when(
                F.col("domain").isNotNull(),
                F.struct((-F.col("pair_n")).alias("neg"), F.col("domain").alias("domain")),
            )
        ).alias("best"),
    )
    return (
        best.select("label", "n", F.coalesce("best.domain", F.lit("other")).alias("domain"))
        .orderBy(F.desc("n"), "label")
        .limit(top)
    )


def imbalance_grade(df: DataFrame) -> DataFrame:
    """Largest over smallest class, over all labels."""
    ratio = F.when(F.count("*") > 1, F.max("n") / F.min("n")).otherwise(F.lit(1.0))
    graded = label_counts(df).agg(F.round(ratio, 6).alias("ratio"))
    return graded.withColumn(
        "grade",
        F.when(F.col("ratio") > 100, "High").when(F.col("ratio") > 10, "Moderate").otherwise("Balanced"),
    )


def class_percentages(df: DataFrame) -> DataFrame:
    """Every label with count and percentage of all rows."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    percent = F.round(100 * F.col("n") / total_of(counts), 4)
    return counts.withColumn("percent", percent).filter("label is not null")


def describe_last_column(df: DataFrame) -> DataFrame:
    """Counts of the last column's values, with the table's row count and columns alongside."""
    last = df.columns[-1]
    counts = df.groupBy(F.col(last).alias("value")).agg(F.count("*").alias("n"))
    return (
        counts.withColumn("rows", total_of(counts))
        .withColumn("columns", F.lit(", ".join(df.columns)))
        .filter("value is not null")
    )


def digest_line(df: DataFrame) -> DataFrame:
    """One line on the table for a reader: reports, domains, classes."""
    by_size = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "domain")))
    domains = domain_counts(df).agg(
        F.concat(F.lit("['"), F.array_join(by_size["domain"], "', '"), F.lit("']")).alias("domains")
    )
    return one_row(dataset_stats(df).select("total_reports", "anomaly_classes"), domains).select(
        F.concat_ws(
            " ",
            F.lit("Loaded dataset:"),
            F.col("total_reports").cast("string"),
            F.lit("reports across"),
            F.col("domains"),
            F.lit("with"),
            F.col("anomaly_classes").cast("string"),
            F.lit("anomaly classes."),
        ).alias("line")
    )


def level_position(level: Column) -> Column:
    """Display order of a level; unknown ones last."""
    position = F.array_position(F.lit(list(lexicon.LEVEL_ORDER)), level)
    return F.when(position > 0, position).otherwise(F.lit(10))
