"""Queries on sources and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import schema
from faultline.catalog import query, views
from faultline.catalog.views import KEPT_LABELS, quoted, sql_list, sql_snippet, sql_strip, with_views
from faultline.functions import lexicon, text
from faultline.functions.text import snippet
from faultline.operators import cleaning, requests
from faultline.session import shared_folder
from faultline.sources import incidents as src
from faultline.sources import reports as rep
from faultline.sources.dropfiles import CSV_WRITER


@query(
    "src1_canonical_columns",
    with_views("select incident_id, narrative, label_raw as label, domain from incidents", "incidents"),
)
def canonical_columns(spark, sf_dir):
    legacy = views.incidents(spark, sf_dir).select(
        "incident_id",
        F.col("narrative").alias("Report 1_Narrative"),
        F.col("label_raw").alias("Events_Anomaly"),
        F.col("domain").alias("Domain"),
        F.lit("x").alias("unused"),
    )
    return src.normalise_columns(legacy, keep=("incident_id",))


@query(
    "src1_csv_incidents",
    with_views(
        "select nullif(narrative, '') as narrative, nullif(label_raw, '') as label, domain from incidents", "incidents"
    ),
)
def csv_incidents(spark, sf_dir):
    """Incidents written as CSV under old column names, line breaks and quotes in them, and loaded again."""
    path = shared_folder(spark, "incidents-csv")
    rows = views.incidents(spark, sf_dir).select(
        F.col("narrative").alias("Narrative"),
        F.col("label_raw").alias("human_factors_groundtruth"),
        F.col("domain").alias("Domain"),
        F.lit("x").alias("unused"),
    )
    rows.write.options(**CSV_WRITER).csv(path)
    return src.load_incidents(spark, path, "csv")


@query(
    "src2_source_rows",
    with_views(
        f"""
        select * from (select incident_id, {sql_strip("narrative")} as narrative, {sql_strip("label_raw")} as label
                       from incidents where domain = 'Aviation') t
        where narrative <> '' and label <> ''
        """,
        "incidents",
    ),
)
def source_rows(spark, sf_dir):
    rows = views.incidents(spark, sf_dir).filter(F.col("domain") == schema.AVIATION)
    return src.source_rows(rows, "incident_id", "narrative", "label_raw")


@query(
    "src4_domain_fallback",
    with_views(
        """
        select incident_id, narrative, label, domain from labelled where domain = 'Aviation'
        union all
        select incident_id, narrative, label, domain from labelled c
        where c.domain not in (select domain from labelled where domain = 'Aviation')
        """,
        "labelled",
    ),
)
def domain_fallback(spark, sf_dir):
    cached = views.labelled(spark, sf_dir)
    fresh = cached.filter(F.col("domain") == schema.AVIATION)
    return src.with_fallback(fresh, cached)


@query(
    "cln1_primary_label",
    with_views("select incident_id, label from labelled", "labelled"),
)
def primary_label(spark, sf_dir):
    return views.labelled(spark, sf_dir).select("incident_id", "label")


@query(
    "cln2_rare_label_buckets",
    with_views("select incident_id, label from bucketed where domain = 'Aviation'", "bucketed"),
)
def rare_label_buckets(spark, sf_dir):
    aviation = views.labelled(spark, sf_dir).filter(F.col("domain") == schema.AVIATION)
    return cleaning.bucket_rare_labels(aviation, KEPT_LABELS).select("incident_id", "label")


@query(
    "un2_bucketed_labels",
    with_views(
        f"""
        select label, count(*) as n from labelled
        where domain = 'Aviation' and label is not null
          and label not in (select label from labelled where domain = 'Aviation' and label is not null
                            group by label order by count(*) desc, label limit {KEPT_LABELS})
        group by label
        """,
        "labelled",
    ),
)
def bucketed_labels(spark, sf_dir):
    aviation = views.labelled(spark, sf_dir).filter(F.col("domain") == schema.AVIATION)
    return cleaning.rare_labels(aviation, KEPT_LABELS)


@query(
    "cln4_merged_domains",
    with_views("select domain, count(*) as n, count(label) as labelled from bucketed group by domain", "bucketed"),
)
def merged_domains(spark, sf_dir):
    rows = views.labelled(spark, sf_dir).drop("domain")
    is_power = F.floor(F.sqrt(F.col("incident_id") % 400)).between(10, 17)
    aviation = cleaning.bucket_rare_labels(rows.filter(~is_power), KEPT_LABELS)
    both = cleaning.tag_domain(aviation, schema.AVIATION).unionByName(
        cleaning.tag_domain(rows.filter(is_power), schema.POWER)
    )
    return both.groupBy("domain").agg(F.count("*").alias("n"), F.count("label").alias("labelled"))


@query(
    "cln5_complete_rows",
    with_views(
        "select incident_id, narrative, label, domain from labelled where narrative is not null and label is not null",
        "labelled",
    ),
)
def complete_rows(spark, sf_dir):
    return cleaning.drop_incomplete(views.labelled(spark, sf_dir))


@query(
    "cln6_minimum_length",
    with_views("select incident_id, narrative from labelled where length(narrative) > 20", "labelled"),
)
def minimum_length(spark, sf_dir):
    return cleaning.drop_short(views.labelled(spark, sf_dir)).select("incident_id", "narrative")


@query(
    "cln7_first_of_each_text",
    """
    select doc_id, text, lang, source from (
        select *, row_number() over (partition by text order by doc_id) rn from documents) t
    where rn = 1
    """,
)
def first_of_each_text(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return cleaning.first_of_each_text(docs, ["doc_id"], "text")


@query(
    "win2_first_page_per_url",
    """
    select page_id, url from (
        select page_id, url, row_number() over (partition by url order by page_id) rn from pages) t
    where rn = 1
    """,
)
def first_page_per_url(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages").select("page_id", "url")
    return cleaning.keep_first(pages, "url", ["page_id"])


@query(
    "snk1_clean_incidents",
    with_views("select incident_id, narrative, label, domain from clean", "clean"),
)
def clean_incidents(spark, sf_dir):
    return views.clean(spark, sf_dir).select("incident_id", "narrative", "label", "domain")


@query(
    "src5_refreshed_table",
    with_views("select incident_id, narrative, label, domain from clean", "clean"),
)
def refreshed_table(spark, sf_dir):
    """Built at the first call, found at the second."""
    path = shared_folder(spark, "incidents")
    for _ in range(2):
        stored = src.refresh(spark, path, lambda cached: views.clean(spark, sf_dir))
    return stored.select("incident_id", "narrative", "label", "domain")


@query(
    "cln8_domain_counts",
    with_views(
        """
        select count(*) filter (where domain = 'Aviation') as aviation_count,
               count(*) filter (where domain = 'Power Grid') as power_grid_count,
               count(*) as total_count
        from clean
        """,
        "clean",
    ),
)
def domain_counts(spark, sf_dir):
    return cleaning.domain_counts_row(views.clean(spark, sf_dir))


@query(
    "cln9_snippets",
    with_views(
        f"""
        select incident_id,
               {sql_snippet("narrative", schema.EVIDENCE_CHARS)} as evidence_snippet,
               {sql_snippet(sql_strip("narrative"), schema.ALERT_CHARS)} as alert_snippet,
               {sql_snippet("narrative", schema.INPUT_CHARS)} as input_snippet
        from incidents where narrative is not null
        """,
        "incidents",
    ),
)
def snippets(spark, sf_dir):
    rows = views.incidents(spark, sf_dir).filter("narrative is not null")
    return rows.select(
        "incident_id",
        snippet(F.col("narrative"), schema.EVIDENCE_CHARS).alias("evidence_snippet"),
        snippet(text.strip(F.col("narrative")), schema.ALERT_CHARS).alias("alert_snippet"),
        snippet(F.col("narrative"), schema.INPUT_CHARS).alias("input_snippet"),
    )


@query(
    "cln10_preview",
    with_views(
        f"""
        select incident_id, {sql_snippet("narrative", schema.PREVIEW_CHARS)} as narrative, domain, label
        from clean order by incident_id limit {schema.PREVIEW_ROWS}
        """,
        "clean",
    ),
)
def preview(spark, sf_dir):
    return cleaning.preview(views.clean(spark, sf_dir), "incident_id")


@query(
    "cln11_request_checks",
    """
    select conv_id, turn,
           case when text is null then 'narrative missing'
                when length(text) < 10 then 'narrative too short'
                when length(text) > 10000 then 'narrative too long'
                when turn not between 1 and 10 then 'top_k out of range' end as reason
    from conversations
    """,
)
def request_checks(spark, sf_dir):
    asked = views.table(spark, sf_dir, "conversations")
    return requests.check_classify_requests(asked, "text", "turn").select("conv_id", "turn", "reason")


@query(
    "cln11_question_checks",
    """
    select conv_id, turn,
           case when text is null or length(text) < 1 then 'query missing'
                when length(text) > 500 then 'query too long' end as reason
    from conversations
    """,
)
def question_checks(spark, sf_dir):
    asked = views.table(spark, sf_dir, "conversations")
    return requests.check_questions(asked, "text").select("conv_id", "turn", "reason")


_LINES = f"""
    select report_id, label, line_no - 1 as line_no, line from (
        select report_id, label, generate_subscripts(kept, 1) as line_no, unnest(kept) as line from (
            select report_id, label, list_filter(list_transform(
                       string_split_regex(text, {quoted(text.LINE_BREAK)}),
                       lambda l: trim(regexp_replace(l, {quoted(text.SPACES)}, ' ', 'g'), ' ')),
                   lambda l: length(l) >= 40
                       and not list_bool_or(list_transform({sql_list(lexicon.REPORT_NOISE)},
                                            lambda t: contains(lower(l), t)))
                       and not regexp_matches(l, '^\\p{{Nd}}+$')
                       and not (length(l) > 60 and upper(l) = l and lower(l) <> l)) as kept
            from reports) a) b
"""
_SENTENCES = f"""
    select report_id, label, sentence_no - 1 as sentence_no, sentence from (
        select report_id, label, generate_subscripts(kept, 1) as sentence_no, unnest(kept) as sentence from (
            select report_id, label, list_filter(list_transform(
                       string_split(regexp_replace(body, {quoted(text.SENTENCE_END)},
                                                   '\\1' || chr(1), 'g'), chr(1)),
                       lambda s: trim(s, ' ')),
                   lambda s: length(s) >= 20) as kept
            from (select report_id, any_value(label) as label, string_agg(line, ' ' order by line_no) as body
                  from lines group by report_id) a) b) c
"""


@query(
    "txt1_report_lines",
    with_views("select * from lines", "reports", lines=_LINES),
)
def report_lines(spark, sf_dir):
    return rep.report_lines(views.reports(spark, sf_dir))


@query(
    "txt2_report_sentences",
    with_views("select * from sentences", "reports", lines=_LINES, sentences=_SENTENCES),
)
def report_sentences(spark, sf_dir):
    return rep.report_sentences(views.reports(spark, sf_dir))


@query(
    "src3_report_narratives",
    with_views(
        """
        select report_id, chunk_no, string_agg(sentence, ' ' order by sentence_no) as narrative,
               any_value(label) as label
        from (select *, sentence_no // 5 as chunk_no from sentences) t
        group by report_id, chunk_no
        """,
        "reports",
        lines=_LINES,
        sentences=_SENTENCES,
    ),
)
def report_narratives(spark, sf_dir):
    return rep.report_narratives(views.reports(spark, sf_dir))
