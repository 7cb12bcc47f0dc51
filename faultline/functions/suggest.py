"""Safety suggestions: detected risk factors and label actions put into one sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import lexicon
from faultline.functions.matching import matching_names, strings, with_lowered


def risk_factors(low_text: Column, low_label: Column) -> Column:
    """Categories found in the text, then those found only in the label."""
    in_text = matching_names(low_text, lexicon.SUGGESTION_CATEGORIES)
    in_label = matching_names(low_label, lexicon.SUGGESTION_CATEGORIES)
    return F.array_union(in_text, in_label)


def label_actions(low_label: Column, limit: int = 3) -> Column:
    """The first distinct actions of every action list whose key occurs in the label."""
    nothing = F.lit([]).cast("array<string>")
    lists = [
        F.when(F.contains(low_label, F.lit(key)), strings(actions)).otherwise(nothing)
        for key, actions in lexicon.LABEL_ACTIONS.items()
    ]
    return F.slice(F.array_distinct(F.flatten(F.array(*lists))), 1, limit)


def base_suggestion(level: Column) -> Column:
    chosen = F.when(F.lit(False), F.lit(""))
    for name, text in lexicon.LEVEL_SUGGESTIONS.items():
        chosen = chosen.when(F.lower(level) == name, F.lit(text))
    return chosen.otherwise(F.lit(lexicon.LEVEL_SUGGESTIONS["medium"]))


def with_suggestion(
    df: DataFrame,
    text: str = "narrative",
    label: str = "predicted_label",
    level: str = "risk_level",
    out: str = "suggestion",
) -> DataFrame:
    parts = with_lowered(df, _low_text=text, _low_label=label).withColumns(
        {
            "_factors": risk_factors(F.col("_low_text"), F.col("_low_label")),
            "_actions": label_actions(F.col("_low_label")),
        }
    )
    sentence = F.concat_ws(
        " ",
        base_suggestion(F.col(level)),
        F.when(
            F.size("_actions") > 0,
            F.concat(F.lit("Recommended actions: "), F.array_join("_actions", "; "), F.lit(".")),
        ),
        F.when(
            F.size("_factors") > 0,
            F.concat(F.lit("Risk factors detected: "), F.array_join("_factors", ", "), F.lit(".")),
        ),
    )
    return parts.withColumn(out, sentence).drop("_low_text", "_low_label", "_factors", "_actions")
