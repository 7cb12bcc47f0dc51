"""Event reports: cleaned lines, sentences and narratives of a few sentences each.

Everything happens inside the report's own row, so a report is never regrouped by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import clean_lines, sentence_groups, sentences

SENTENCES_PER_NARRATIVE = 5


def report_lines(reports: DataFrame) -> DataFrame:
    """Kept lines of (report_id, label, text) with their order."""
    return reports.select("report_id", "label", F.posexplode(clean_lines(F.col("text"))).alias("line_no", "line"))


def report_sentences(reports: DataFrame) -> DataFrame:
    kept = reports.withColumn("_lines", clean_lines(F.col("text")))
    return kept.select(
        "report_id", "label", F.posexplode(sentences(F.col("_lines"))).alias("sentence_no", "sentence")
    )


def report_narratives(reports: DataFrame, group: int = SENTENCES_PER_NARRATIVE) -> DataFrame:
    """Incident rows of event reports: `group` sentences per narrative, label = event name."""
    kept = reports.withColumn("_sentences", sentences(clean_lines(F.col("text"))))
    return kept.select(
        "report_id",
        F.posexplode(sentence_groups(F.col("_sentences"), group)).alias("chunk_no", "narrative"),
        "label",
    )
