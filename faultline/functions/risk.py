"""Risk levels from label keywords, text triggers and source-given floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions import lexicon
from faultline.functions.matching import any_match, strings, with_lowered


def label_risk(low_label: Column) -> Column:
    return (
        F.when(any_match(low_label, lexicon.LABEL_CRITICAL), "critical")
        .when(any_match(low_label, lexicon.LABEL_HIGH), "high")
        .otherwise("medium")
    )


def incident_risk(low_text: Column, low_label: Column) -> Column:
    """A critical trigger in the text wins, then the label's own level, then a high trigger."""
    return (
        F.when(any_match(low_text, lexicon.TEXT_CRITICAL), "critical")
        .when(any_match(low_label, lexicon.LABEL_CRITICAL), "critical")
        .when(any_match(low_label, lexicon.LABEL_HIGH), "high")
        .when(any_match(low_text, lexicon.TEXT_HIGH), "high")
        .otherwise("medium")
    )


def risk_rank(level: Column) -> Column:
    return F.array_position(strings(lexicon.RISK_ORDER), level)


def raise_to_floor(level: Column, floor: Column) -> Column:
    return F.when(risk_rank(level) < risk_rank(floor), floor).otherwise(level)


def customer_floor(customers: Column, threshold: int = schema.HIGH_RISK_CUSTOMERS) -> Column:
    return F.when(customers >= threshold, F.lit("high"))


def is_alert(level: Column) -> Column:
    return level.isin("critical", "high")


def with_label_risk(df: DataFrame, label: str = "label", out: str = "risk_level") -> DataFrame:
    low = with_lowered(df, _low_label=label)
    return low.withColumn(out, label_risk(F.col("_low_label"))).drop("_low_label")


def with_incident_risk(
    df: DataFrame,
    text: str = "narrative",
    label: str = "label",
    floor: str | None = None,
    out: str = "risk_level",
) -> DataFrame:
    low = with_lowered(df, _low_text=text, _low_label=label)
    scored = low.withColumn(out, incident_risk(F.col("_low_text"), F.col("_low_label")))
    if floor is not None:
        scored = scored.withColumn(out, raise_to_floor(F.col(out), F.col(floor)))
    return scored.withColumn("is_alert", is_alert(F.col(out))).drop("_low_text", "_low_label")
