"""Views over the alert log: the latest alerts, counts per level, filters and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.suggest import with_suggestion
from faultline.operators.audit import level_position, one_row


def alert_feed(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """The latest alerts with their suggestion; alerts without a time come last."""
    latest = alerts.orderBy(F.col("alert_ts").desc_nulls_last(), "incident_id").limit(limit)
    return with_suggestion(latest)


def level_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("risk_level").agg(F.count("*").alias("n"))


def level_summary(alerts: DataFrame) -> DataFrame:
    """One line with the total and the counts in order of severity."""
    counts = level_counts(alerts.withColumn("risk_level", F.coalesce("risk_level", F.lit("medium"))))
    entry = F.struct(
        level_position(F.col("risk_level")).alias("position"),
        F.concat_ws("=", "risk_level", F.col("n").cast("string")).alias("text"),
    )
    gathered = counts.agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(entry)).alias("entries"))
    return gathered.filter("total > 0").select(
        F.concat(
            F.lit("Live alert feed: "),
            F.col("total").cast("string"),
            F.lit(" total alerts logged.\nCurrent breakdown: "),
            F.array_join(F.col("entries.text"), ", "),
        ).alias("summary")
    )


def filter_alerts(alerts: DataFrame, level: str | None = None, source: str | None = None) -> DataFrame:
    if level is not None:
        alerts = alerts.filter(F.col("risk_level") == level)
    if source is not None:
        alerts = alerts.filter(F.col("source") == source)
    return alerts


def alert_facets(alerts: DataFrame) -> DataFrame:
    """Counts per level, per source and in total from one grouped pass."""
    named = alerts.select("risk_level", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source"))
    grouped = named.groupingSets([["risk_level"], ["source"], []], "risk_level", "source").agg(
        F.count("*").alias("n"), F.grouping_id().alias("_set")
    )
    # grouping_id: 1 = per level, 2 = per source, 3 = total.
    facet = F.when(F.col("_set") == 1, "level").when(F.col("_set") == 2, "source").otherwise("all")
    value = F.when(F.col("_set") == 1, F.col("risk_level")).when(F.col("_set") == 2, F.col("source")).otherwise("all")
    return grouped.select(facet.alias("facet"), value.alias("value"), "n")


def digest_context(incident_line: DataFrame, alerts: DataFrame) -> DataFrame:
    """The table's digest line followed by the alert summary."""
    return one_row(incident_line, level_summary(alerts)).select(
        F.concat_ws("\n", "line", "summary").alias("context")
    )
