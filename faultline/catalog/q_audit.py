"""Queries on counts, shares, audits and question routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.catalog import query, views
from faultline.catalog.views import (
    quoted,
    sql_any,
    sql_categories,
    sql_label_risk,
    sql_strip,
    with_views,
)
from faultline.functions import lexicon
from faultline.operators import audit, routing

_STATS = """
    select count(*) as total_reports, count(distinct label) as anomaly_classes,
           min(length(narrative)) as min_length, max(length(narrative)) as max_length,
           round(avg(length(narrative)), 6) as avg_length, median(length(narrative)) as median_length
    from bucketed
"""


@query("agg1_dataset_stats", with_views(_STATS, "bucketed"))
def dataset_stats(spark, sf_dir):
    return audit.dataset_stats(_bucketed(spark, sf_dir))


def _bucketed(spark, sf_dir):
    from faultline import schema
    from faultline.operators.cleaning import bucket_rare_labels

    rows = views.labelled(spark, sf_dir)
    power = rows.filter(F.col("domain") == schema.POWER)
    aviation = rows.filter(F.col("domain") == schema.AVIATION)
    return bucket_rare_labels(aviation, views.KEPT_LABELS).unionByName(power)


@query(
    "agg1_rows_per_domain",
    with_views("select domain, count(*) as n from labelled group by domain", "labelled"),
)
def rows_per_domain(spark, sf_dir):
    return audit.domain_counts(views.labelled(spark, sf_dir))


@query(
    "agg1_top_labels",
    with_views(
        "select label, count(*) as n from labelled where label is not null group by label "
        "order by n desc, label limit 20",
        "labelled",
    ),
)
def top_labels(spark, sf_dir):
    return audit.top_classes(views.labelled(spark, sf_dir), 20)


_SHARES = """
    select label, n, round(n / sum(n) over (), 6) as share from (
        select label, count(*) as n from bucketed group by label) t
"""


@query(
    "agg2_class_distribution",
    with_views(
        "select * from shares where label is not null order by n desc, label limit 16", "bucketed", shares=_SHARES
    ),
)
def class_distribution(spark, sf_dir):
    return audit.class_distribution(_bucketed(spark, sf_dir), 16)


AUDIT = """
    select (select count(*) from bucketed) as rows,
           (select count(*) from bucketed where label is null) as missing_labels,
           (select count(*) from bucketed where narrative is null) as missing_narratives,
           (select count(*) from bucketed where length(narrative) < 20) as short_narratives,
           (select min(length(narrative)) from bucketed) as min_length,
           (select round(avg(length(narrative)), 6) from bucketed) as avg_length,
           (select max(length(narrative)) from bucketed) as max_length,
           (select round(count(*) filter (where label = 'Other') / count(*), 6) from bucketed) as other_share,
           (select count(narrative) - count(distinct narrative) from bucketed) as duplicate_narratives,
           (select count(*) from classes) as classes,
           (select label from classes order by n desc, label limit 1) as majority_class,
           (select max(n) from classes) as majority_rows,
           (select label from classes order by n, label desc limit 1) as minority_class,
           (select min(n) from classes) as minority_rows,
           (select round(max(n) / greatest(1, min(n)), 6) from classes) as imbalance,
           (select count(distinct word) from (
               select unnest(string_split_regex(lower(narrative), '\\s+')) as word from (
                   select narrative from bucketed where narrative is not null) f
           ) w) as vocabulary
"""
CLASSES = "select label, count(*) as n from bucketed where label is not null group by label"


@query("agg3_quality_audit", with_views(AUDIT, "bucketed", classes=CLASSES))
def quality_audit(spark, sf_dir):
    return audit.quality_audit(_bucketed(spark, sf_dir))


GRADED = """
    select 'Total rows' as metric, cast(rows as varchar) as value, 'OK' as status from audited
    union all select 'Columns', 'incident_id, narrative, label, domain', 'OK' from audited
    union all select 'Missing labels', cast(missing_labels as varchar),
                     case when missing_labels > 0 then 'WARN' else 'OK' end from audited
    union all select 'Missing narratives', cast(missing_narratives as varchar),
                     case when missing_narratives > 0 then 'WARN' else 'OK' end from audited
    union all select 'Duplicate narratives', cast(duplicate_narratives as varchar),
                     case when duplicate_narratives > 0 then 'WARN' else 'OK' end from audited
    union all select 'Very short narratives (<20 chars)', cast(short_narratives as varchar),
                     case when short_narratives > 0 then 'WARN' else 'OK' end from audited
    union all select 'Class imbalance (majority/minority ratio)',
                     cast(round(imbalance, 1) as varchar) || 'x',
                     case when imbalance > 10 then 'WARN' else 'OK' end from audited
    union all select '''Other'' bucket coverage', cast(round(other_share * 100, 1) as varchar) || '%',
                     case when other_share > 0.5 then 'WARN' else 'OK' end from audited
    union all select 'Distinct classes', cast(classes as varchar), 'OK' from audited
"""


@query(
    "agg4_graded_audit",
    with_views(
        GRADED,
        "bucketed",
        classes=CLASSES,
        audited=AUDIT,
    ),
)
def graded_audit(spark, sf_dir):
    rows = _bucketed(spark, sf_dir).select("incident_id", "narrative", "label", "domain")
    return audit.graded_audit(rows)


_LEVELS = f"""
    select {sql_label_risk("lower(coalesce(label, ''))")} as risk_level, label from labelled
"""


@query(
    "agg5_criticality",
    with_views(
        """
        select l.risk_level, count(r.risk_level) as n,
               round(count(r.risk_level) / (select count(*) from levels), 6) as share
        from (values ('critical'), ('high'), ('medium')) l(risk_level)
        left join levels r on r.risk_level = l.risk_level
        group by l.risk_level
        """,
        "labelled",
        levels=_LEVELS,
    ),
)
def criticality(spark, sf_dir):
    return audit.criticality(views.labelled(spark, sf_dir))


@query(
    "agg5_clean_criticality",
    with_views(
        f"""
        select l.risk_level, count(r.risk_level) as n,
               round(count(r.risk_level) / (select count(*) from clean), 6) as share
        from (values ('critical'), ('high'), ('medium')) l(risk_level)
        left join (select {sql_label_risk("lower(label)")} as risk_level from clean) r
          on r.risk_level = l.risk_level
        group by l.risk_level
        """,
        "clean",
    ),
)
def clean_criticality(spark, sf_dir):
    return audit.criticality(views.clean(spark, sf_dir))


@query(
    "agg5_top_critical_labels",
    with_views(
        """
        select label, count(*) as n from levels where risk_level = 'critical' and label is not null
        group by label order by n desc, label limit 5
        """,
        "labelled",
        levels=_LEVELS,
    ),
)
def top_critical_labels(spark, sf_dir):
    return audit.top_critical_labels(views.labelled(spark, sf_dir))


@query(
    "agg6_dominant_domains",
    with_views(
        """
        select label, n, domain from (
            select label, domain, sum(pair_n) over (partition by label) as n,
                   row_number() over (partition by label order by pair_n desc, domain) as rn
            from (select label, domain, count(*) as pair_n from labelled where label is not null
                  group by label, domain) p) q
        where rn = 1 order by n desc, label limit 10
        """,
        "labelled",
    ),
)
def dominant_domains(spark, sf_dir):
    return audit.dominant_domains(views.labelled(spark, sf_dir), 10)


@query(
    "agg10_imbalance_grade",
    with_views(
        """
        select ratio, case when ratio > 100 then 'High' when ratio > 10 then 'Moderate' else 'Balanced' end as grade
        from (select round(case when count(*) > 1 then max(n) / min(n) else 1.0 end, 6) as ratio from (
            select count(*) as n from labelled where label is not null group by label
            ) t) r
        """,
        "labelled",
    ),
)
def imbalance_grade(spark, sf_dir):
    return audit.imbalance_grade(views.labelled(spark, sf_dir))


@query(
    "agg11_class_percentages",
    with_views(
        """
        select * from (select label, n, round(100 * n / sum(n) over (), 4) as percent from (
            select label, count(*) as n from labelled group by label) t) s
        where label is not null
        """,
        "labelled",
    ),
)
def class_percentages(spark, sf_dir):
    return audit.class_percentages(views.labelled(spark, sf_dir))


@query(
    "agg14_digest_line",
    with_views(
        """
        select 'Loaded dataset: ' || (select count(*) from labelled) || ' reports across ['''
               || (select string_agg(domain, ''', ''' order by n desc, domain)
                   from (select domain, count(*) as n from labelled group by domain) d)
               || '''] with ' || (select count(distinct label) from labelled) || ' anomaly classes.' as line
        """,
        "labelled",
    ),
)
def digest_line(spark, sf_dir):
    return audit.digest_line(views.labelled(spark, sf_dir))


@query(
    "agg15_last_column",
    with_views(
        """
        select domain as value, count(*) as n, (select count(*) from labelled) as rows,
               'incident_id, narrative, label, domain' as columns
        from labelled group by domain
        """,
        "labelled",
    ),
)
def last_column(spark, sf_dir):
    return audit.describe_last_column(views.labelled(spark, sf_dir))


@query(
    "txt15_vocabulary_size",
    with_views(
        """
        select count(distinct word) as vocabulary from (
            select unnest(string_split_regex(lower(narrative), '\\s+')) as word from (
                select narrative from labelled where narrative is not null) f) w
        """,
        "labelled",
    ),
)
def vocabulary_size(spark, sf_dir):
    return audit.vocabulary_size(views.labelled(spark, sf_dir))


def _sql_route(q: str) -> str:
    return f"""
               case when {q} = '' then 'empty'
                    when {sql_any(q, lexicon.QUALITY_WORDS)} then 'quality'
                    when {sql_any(q, lexicon.SAFETY_WORDS)} then 'safety'
                    when {sql_any(q, lexicon.CLASS_WORDS)} then 'classes'
                    when starts_with({q}, 'analyze') then 'analyze'
                    when starts_with({q}, 'summary') then 'summary'
                    else 'help' end"""


@query(
    "rte1_question_routes",
    with_views(
        f"""
        select conv_id, turn, query, {_sql_route("q")} as query_route, {_sql_route("t")} as text_route
        from (select *, {sql_strip("lower(query)")} as q, {sql_strip("lower(coalesce(text, ''))")} as t from questions) u
        """,
        "questions",
    ),
)
def question_routes(spark, sf_dir):
    routed = routing.with_route(views.questions(spark, sf_dir)).withColumnRenamed("route", "query_route")
    return routing.with_route(routed, "text").withColumnRenamed("route", "text_route").drop("text")


@query(
    "rte2_summary",
    with_views(
        """
        select (select count(*) from bucketed) as total_reports,
               (select count(distinct label) from bucketed) as anomaly_classes, 4 as column_count, *
        from audited
        """,
        "bucketed",
        classes=CLASSES,
        audited=AUDIT,
    ),
)
def summary(spark, sf_dir):
    rows = _bucketed(spark, sf_dir).select("incident_id", "narrative", "label", "domain")
    return routing.summary(rows)


@query(
    "txt13_domain_relevance",
    with_views(
        f"""
        select conv_id, turn, {sql_any("lower(query)", lexicon.DOMAIN_KEYWORDS)} as question_in_domain,
               {sql_any("lower(coalesce(text, ''))", lexicon.DOMAIN_KEYWORDS)} as text_in_domain
        from questions
        """,
        "questions",
    ),
)
def domain_relevance(spark, sf_dir):
    asked = views.questions(spark, sf_dir)
    first = routing.with_relevance(asked, "query").withColumnRenamed("in_domain", "question_in_domain")
    both = routing.with_relevance(first, "text").withColumnRenamed("in_domain", "text_in_domain")
    return both.select("conv_id", "turn", "question_in_domain", "text_in_domain")


@query(
    "txt9_risk_phrases",
    with_views(
        f"""
        select incident_id, array_to_string({sql_categories("low", lexicon.RISK_CATEGORIES)}, {quoted(" | ")}) as phrases
        from (select incident_id, lower(coalesce(narrative, '')) as low from incidents) t
        """,
        "incidents",
    ),
)
def risk_phrases(spark, sf_dir):
    scanned = routing.with_risk_phrases(views.incidents(spark, sf_dir))
    return scanned.select("incident_id", F.array_join("phrases", " | ").alias("phrases"))
