"""Limits on requests: tables of requests are split by row, single parameters checked directly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted ranges.
NARRATIVE_CHARS = (10, 10000)
QUERY_CHARS = (1, 500)
TOP_K = (1, 10)
PARAMETER_RANGES = {
    "top_k": TOP_K,
    "limit": (1, 500),
    "poll_seconds": (10, 3600),
    "samples": (10, 1000),
    "n_samples": (10, 1000),
    "nrows_aviation": (100, 10000),
    "max_features": (1000, 20000),
    "test_size": (0.1, 0.5),
    "cv_folds": (2, 10),
    "max_iter": (100, 5000),
    "plot_top_n": (5, 20),
}


def check_parameters(**given: float) -> None:
    for name, value in given.items():
        low, high = PARAMETER_RANGES[name]
        if not low <= value <= high:
            raise ValueError(f"{name} must lie between {low} and {high}, not {value}")


def check_classify_requests(requests: DataFrame, narrative: str = "narrative", top_k: str = "top_k") -> DataFrame:
    """Add `reason`: null for a valid request, else the first rule it breaks."""
    chars = F.length(narrative)
    reason = (
        F.when(F.col(narrative).isNull(), "narrative missing")
        .when(chars < NARRATIVE_CHARS[0], "narrative too short")
        .when(chars > NARRATIVE_CHARS[1], "narrative too long")
        .when(~F.col(top_k).between(*TOP_K), "top_k out of range")
    )
    return requests.withColumn("reason", reason)


def check_questions(questions: DataFrame, query: str = "query") -> DataFrame:
    chars = F.length(query)
    reason = (
        F.when(F.col(query).isNull() | (chars < QUERY_CHARS[0]), "query missing")
        .when(chars > QUERY_CHARS[1], "query too long")
    )
    return questions.withColumn("reason", reason)


def split_requests(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a checked table."""
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")
