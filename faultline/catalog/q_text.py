"""Queries on text normalisation, risk scores and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.catalog import query, sqltext, views
from faultline.catalog.views import quoted, sql_any, sql_categories, sql_list, with_views
from faultline.functions import lexicon, risk, suggest, text
from faultline.functions.matching import any_match, with_lowered
from faultline.operators.features import add_processed, lemmatise_by_table
from faultline.session import materialise


@query(
    "txt4_core_normalised",
    with_views(
        f"select incident_id, {sqltext.normalise('narrative')} as processed_text from incidents", "incidents"
    ),
)
def core_normalised(spark, sf_dir):
    return add_processed(views.incidents(spark, sf_dir)).select("incident_id", "processed_text")


@query(
    "txt5_api_normalised",
    with_views(
        f"select incident_id, {sqltext.normalise('narrative', 'api')} as processed_text from incidents", "incidents"
    ),
)
def api_normalised(spark, sf_dir):
    return add_processed(views.incidents(spark, sf_dir), profile="api").select("incident_id", "processed_text")


@query(
    "txt6_lemmas",
    f"""
    select token, {sqltext.lemma("token")} as lemma, count(*) as n
    from (select unnest({sqltext.core_tokens("text")}) as token from documents) t
    group by token
    """,
)
def lemmas(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    tokens = docs.select(F.explode(text.core_tokens(F.col("text"))).alias("token"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return counted.withColumn("lemma", F.expr(text.lemma_sql("token")))


@query(
    "txt6_lemma_table",
    with_views(
        f"select incident_id, {sqltext.normalise('narrative')} as processed_text from incidents "
        "where narrative is not null",
        "incidents",
    ),
)
def lemma_table(spark, sf_dir):
    """The same texts with the lemmas looked up in a table of every word and its lemma."""
    rows = views.incidents(spark, sf_dir).filter("narrative is not null")
    words = rows.select("incident_id", text.normalise(F.col("narrative"), lemmas=False).alias("words"))
    words = materialise(words, "plain-words")
    vocabulary = words.select(F.explode(F.split("words", " ")).alias("word")).distinct()
    lemmas = vocabulary.withColumn("lemma", F.expr(text.lemma_sql("word")))
    return lemmatise_by_table(words, lemmas, "incident_id")


@query(
    "txt8_trigger_matches",
    with_views(
        f"""
        select incident_id, {sql_any("low", lexicon.TEXT_CRITICAL)} as critical_trigger,
               {sql_any("low", lexicon.TEXT_HIGH)} as high_trigger
        from (select incident_id, lower(coalesce(narrative, '')) as low from incidents) t
        """,
        "incidents",
    ),
)
def trigger_matches(spark, sf_dir):
    low = with_lowered(views.incidents(spark, sf_dir), low="narrative")
    return low.select(
        "incident_id",
        any_match(F.col("low"), lexicon.TEXT_CRITICAL).alias("critical_trigger"),
        any_match(F.col("low"), lexicon.TEXT_HIGH).alias("high_trigger"),
    )


def _sql_factors(low_text: str, low_label: str) -> str:
    in_text = sql_categories(low_text, lexicon.SUGGESTION_CATEGORIES)
    in_label = sql_categories(low_label, lexicon.SUGGESTION_CATEGORIES)
    return f"({in_text} || list_filter({in_label}, lambda c: not list_contains({in_text}, c)))"


def _sql_actions(low_label: str) -> str:
    lists = " || ".join(
        f"case when {sql_any(low_label, [key])} then {sql_list(actions)} else [] end"
        for key, actions in lexicon.LABEL_ACTIONS.items()
    )
    return (
        f"list_filter({lists}, lambda a, i: list_position({lists}, a) = i)[1:3]"
    )


_LOWERED = """
    select incident_id, label, narrative, lower(coalesce(narrative, '')) as low_text,
           lower(coalesce(label, '')) as low_label
    from labelled
"""


@query(
    "txt10_risk_factors",
    with_views(
        f"select incident_id, array_to_string({_sql_factors('low_text', 'low_label')}, ' | ') as factors from lowered",
        "labelled",
        lowered=_LOWERED,
    ),
)
def risk_factors(spark, sf_dir):
    low = with_lowered(views.labelled(spark, sf_dir), low_text="narrative", low_label="label")
    factors = suggest.risk_factors(F.col("low_text"), F.col("low_label"))
    return low.select("incident_id", F.array_join(factors, " | ").alias("factors"))


@query(
    "txt11_label_actions",
    with_views(
        f"select incident_id, array_to_string({_sql_actions('low_label')}, ' | ') as actions from lowered",
        "labelled",
        lowered=_LOWERED,
    ),
)
def label_actions(spark, sf_dir):
    low = with_lowered(views.labelled(spark, sf_dir), low_label="label")
    return low.select("incident_id", F.array_join(suggest.label_actions(F.col("low_label")), " | ").alias("actions"))


def sql_suggestion(low_text: str, low_label: str, level: str) -> str:
    """SQL form of the suggestion sentence, over a row source with the three columns."""
    bases = " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in lexicon.LEVEL_SUGGESTIONS.items())
    actions, factors = _sql_actions(low_label), _sql_factors(low_text, low_label)
    return (
        f"concat_ws(' ', case {level} {bases} else {quoted(lexicon.LEVEL_SUGGESTIONS['medium'])} end, "
        f"case when len({actions}) > 0 then 'Recommended actions: ' || array_to_string({actions}, '; ') || '.' end, "
        f"case when len({factors}) > 0 then 'Risk factors detected: ' || array_to_string({factors}, ', ') || '.' end)"
    )


@query(
    "txt12_suggestions",
    with_views(
        f"select incident_id, {sql_suggestion('low_text', 'low_label', 'risk_level')} as suggestion from scored",
        "scored",
    ),
)
def suggestions(spark, sf_dir):
    scored = risk.with_incident_risk(views.labelled(spark, sf_dir))
    return suggest.with_suggestion(scored, label="label").select("incident_id", "suggestion")


def _sql_redacted(column: str) -> str:
    for old, new in lexicon.PATH_REPLACEMENTS:
        column = f"replace({column}, {quoted(old)}, {quoted(new)})"
    return column


def _sql_shown(line: str) -> str:
    """What a screen shows of a line, step by step."""
    steps = (
        (r"[A-Za-z]:\\[\\/A-Za-z0-9_. -]+", "[system-path]"),
        (r"\\[\\/A-Za-z0-9_. -]*/([^\\/A-Za-z0-9_. -]|$)", r"[system-path]\1"),
        (r"\\[\\/A-Za-z0-9_. -]*/([\\A-Za-z0-9_. -]+)", r"\1"),
        (r"(?i)/Users/[^\n]+", "[user-path]"),
        (r"(?i)/home/[^\n]+", "[home-path]"),
        (r"(?i)/workspace/[^\n]+", "[workspace-path]"),
    )
    for pattern, new in steps:
        line = f"regexp_replace({line}, '{pattern}', '{new}', 'g')"
    return line


@query(
    "txt14_redacted_lines",
    with_views(
        f"""
        select event_id, {_sql_redacted("line")} as line,
               {_sql_shown("line")} as shown
        from log_lines
        """,
        "log_lines",
    ),
)
def redacted_lines(spark, sf_dir):
    lines = views.log_lines(spark, sf_dir)
    return lines.select(
        "event_id",
        text.redact_paths(F.col("line")).alias("line"),
        text.redact_paths_for_display(F.col("line")).alias("shown"),
    )


@query(
    "txt16_safe_file_ids",
    "select p_partkey, regexp_replace(p_type || '/' || p_name, '[^\\p{L}\\p{N}_-]', '_', 'g') as file_id from part",
)
def safe_file_ids(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    name = F.concat("p_type", F.lit("/"), "p_name")
    return part.select("p_partkey", text.safe_file_id(name).alias("file_id"))


@query("txt17_content_keys", "select doc_id, left(sha1(text), 16) as key from documents")
def content_keys(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    return docs.select("doc_id", text.content_key(F.col("text")).alias("key"))


@query(
    "rsk1_label_risk",
    with_views(
        f"select incident_id, {views.sql_label_risk('low_label')} as risk_level from scored", "scored"
    ),
)
def label_risk(spark, sf_dir):
    return risk.with_label_risk(views.labelled(spark, sf_dir)).select("incident_id", "risk_level")


@query("rsk2_incident_risk", with_views("select incident_id, risk_level from scored", "scored"))
def incident_risk(spark, sf_dir):
    return risk.with_incident_risk(views.labelled(spark, sf_dir)).select("incident_id", "risk_level")


@query(
    "rsk3_risk_floor",
    with_views(
        """
        select incident_id, case when risk_level = 'medium' and length(narrative) > 1000 then 'high'
                                 else risk_level end as risk_level,
               risk_level <> 'medium' or coalesce(length(narrative) > 1000, false) as is_alert
        from scored
        """,
        "scored",
    ),
)
def risk_floor(spark, sf_dir):
    rows = views.labelled(spark, sf_dir).withColumn("floor", F.when(F.length("narrative") > 1000, "high"))
    return risk.with_incident_risk(rows, floor="floor").select("incident_id", "risk_level", "is_alert")


@query(
    "rsk4_customer_floor",
    with_views(
        """
        select incidentreference, case when nocustomeraffected >= 100 then 'high' end as risk_floor from faults
        """,
        "faults",
    ),
)
def customer_floor(spark, sf_dir):
    faults = views.faults(spark, sf_dir)
    return faults.select("incidentreference", risk.customer_floor(F.col("nocustomeraffected")).alias("risk_floor"))


@query(
    "rsk5_alert_flags",
    with_views(
        "select risk_level, risk_level in ('critical', 'high') as is_alert, count(*) as n from scored group by 1, 2",
        "scored",
    ),
)
def alert_flags(spark, sf_dir):
    scored = risk.with_incident_risk(views.labelled(spark, sf_dir))
    return scored.groupBy("risk_level", "is_alert").agg(F.count("*").alias("n"))
