"""The alert log: one row per raised alert, evidence as a JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema
from faultline.sources.dropfiles import read_csv


def to_log_rows(alerts: DataFrame) -> DataFrame:
    """The seven columns of the log from scored alerts (`alert_ts` timestamp, `evidence` array)."""
    return alerts.select(
        F.date_format("alert_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "incident_id",
        "source",
        "risk_level",
        "predicted_label",
        "narrative",
        F.to_json("evidence").alias("evidence_json"),
    )


def parse_alert_log(rows: DataFrame) -> DataFrame:
    """Log rows with a real timestamp (null when unreadable) and the evidence as an array."""
    evidence = F.from_json(F.nullif(F.btrim("evidence_json"), F.lit("")), schema.EVIDENCE)
    return rows.select(
        F.try_to_timestamp("timestamp").alias("alert_ts"),
        "incident_id",
        "source",
        F.lower("risk_level").alias("risk_level"),
        "predicted_label",
        "narrative",
        F.coalesce(evidence, F.array().cast(schema.EVIDENCE)).alias("evidence"),
    )


def read_alert_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of alert logs kept as CSV files with a header."""
    return parse_alert_log(read_csv(spark, path).select(*schema.ALERT_LOG.fieldNames()))
