"""Queries on feeds and the alert log."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.catalog import query, views
from faultline.catalog.q_text import sql_suggestion
from faultline.catalog.views import with_views
from faultline.operators import alerts as ops
from faultline.operators import audit
from faultline.session import shared_folder
from faultline.sources import alerts as log
from faultline.sources import feeds
from faultline.sources.dropfiles import CSV_WRITER

_ACCIDENT_ROWS = """
    select 'ntsb-' || ev_id as key, 'ntsb-' || ev_id as incident_id, 'NTSB API' as source,
           concat_ws(' ', 'a ' || concat_ws(' ', nullif(acft_make, ''), nullif(acft_model, '')),
                     'at ' || nullif(ev_city, ''),
                     '(' || ev_highest_injury || ' injury outcome)') || ': ' || probable_cause as narrative,
           cast(null as varchar) as risk_floor
    from accidents where probable_cause <> ''
"""
_FAULT_ROWS = """
    select 'ukpn-' || incidentreference as key, 'ukpn-' || incidentreference as incident_id,
           'UKPN Live Faults' as source,
           concat_ws('. ', rtrim(coalesce(nullif(mainmessage, ''), 'Unplanned power cut'), '.'),
                     'Affecting the ' || operatingzone || ' operating zone',
                     case when nocustomeraffected > 0
                          then cast(nocustomeraffected as varchar) || ' customers affected' end) || '.' as narrative,
           case when nocustomeraffected >= 100 then 'high' end as risk_floor
    from faults where lower(powercuttype) = 'unplanned'
"""


@query("src8_accident_incidents", with_views(_ACCIDENT_ROWS, "accidents"))
def accident_incidents(spark, sf_dir):
    return feeds.accident_incidents(views.accidents(spark, sf_dir))


@query("src9_fault_incidents", with_views(_FAULT_ROWS, "faults"))
def fault_incidents(spark, sf_dir):
    return feeds.fault_incidents(views.faults(spark, sf_dir))


def _landed(spark, records, kind):
    """The records written as JSON lines and read back as a feed of their kind."""
    path = shared_folder(spark, f"landed-{kind}")
    records.write.json(path)
    return feeds.read_feed(spark, path, kind)


@query("src8_landed_accidents", with_views(_ACCIDENT_ROWS, "accidents"))
def landed_accidents(spark, sf_dir):
    return feeds.accident_incidents(_landed(spark, views.accidents(spark, sf_dir), "accident"))


@query("src9_landed_faults", with_views(_FAULT_ROWS, "faults"))
def landed_faults(spark, sf_dir):
    return feeds.fault_incidents(_landed(spark, views.faults(spark, sf_dir), "fault"))


@query(
    "str11_feed_rejects",
    with_views(
        """
        select 'not an unplanned cut' as reason, count(*) as n from faults where lower(powercuttype) <> 'unplanned'
        union all
        select 'no cause', count(*) from accidents where probable_cause = ''
        """,
        "faults",
        "accidents",
    ),
)
def feed_rejects(spark, sf_dir):
    rejected = feeds.fault_rejects(views.faults(spark, sf_dir)).select("reason")
    both = rejected.unionAll(feeds.accident_rejects(views.accidents(spark, sf_dir)).select("reason"))
    return both.groupBy("reason").agg(F.count("*").alias("n"))


def _log_rows(spark, sf_dir):
    """Alert log rows: every 50th time unreadable, evidence of one entry or blank."""
    alerts = views.alerts(spark, sf_dir)
    entry = F.struct(
        F.lit(1).alias("rank"),
        F.lit(0.5).alias("similarity"),
        F.col("predicted_label").alias("label"),
        "domain",
        F.col("source").alias("snippet"),
    )
    with_evidence = alerts.withColumn("evidence", F.array(entry))
    rows = log.to_log_rows(with_evidence)
    number = F.col("incident_id").cast("bigint")
    return rows.withColumns(
        {
            "timestamp": F.when(number % 50 == 7, "not a time").otherwise(F.col("timestamp")),
            "evidence_json": F.when(number % 10 == 3, " ").otherwise(F.col("evidence_json")),
        }
    )


_LOG_ROWS = """
    select incident_id,
           case when incident_id % 50 = 7 then null else strftime(alert_ts, '%Y-%m-%d %H:%M:%S') end as alert_time,
           source, risk_level, predicted_label, narrative,
           case when incident_id % 10 = 3 then 0 else 1 end as evidence_items,
           case when incident_id % 10 = 3 then null else predicted_label end as evidence_label
    from alerts
"""


def _shown(parsed):
    return parsed.select(
        "incident_id",
        F.date_format("alert_ts", "yyyy-MM-dd HH:mm:ss").alias("alert_time"),
        "source",
        "risk_level",
        "predicted_label",
        "narrative",
        F.size("evidence").alias("evidence_items"),
        F.get("evidence", F.lit(0))["label"].alias("evidence_label"),
    )


@query("src10_alert_log", with_views(_LOG_ROWS, "alerts"))
def alert_log(spark, sf_dir):
    return _shown(log.parse_alert_log(_log_rows(spark, sf_dir)))


@query("src10_landed_log", with_views(_LOG_ROWS.replace("narrative,", "nullif(narrative, '') as narrative,"), "alerts"))
def landed_log(spark, sf_dir):
    """The same log written as CSV files, line breaks and all, and read back: an empty narrative is null."""
    path = shared_folder(spark, "landed-log")
    _log_rows(spark, sf_dir).write.options(**CSV_WRITER).csv(path)
    return _shown(log.read_alert_log(spark, path).withColumn("incident_id", F.col("incident_id").cast("bigint")))


@query(
    "snk2_alert_log_rows",
    with_views(
        """
        select strftime(alert_ts, '%Y-%m-%dT%H:%M:%S') as timestamp, incident_id, source, risk_level, predicted_label,
               narrative,
               '[{"rank":1,"similarity":0.5,"label":"' || predicted_label || '","domain":"' || domain
               || '","snippet":"' || source || '"}]' as evidence_json
        from alerts where predicted_label is not null
        """,
        "alerts",
    ),
)
def alert_log_rows(spark, sf_dir):
    alerts = views.alerts(spark, sf_dir).filter("predicted_label is not null")
    entry = F.struct(
        F.lit(1).alias("rank"),
        F.lit(0.5).alias("similarity"),
        F.col("predicted_label").alias("label"),
        "domain",
        F.col("source").alias("snippet"),
    )
    return log.to_log_rows(alerts.withColumn("evidence", F.array(entry)))


@query(
    "agg7_alert_feed",
    with_views(
        f"""
        select incident_id, strftime(alert_ts, '%Y-%m-%d %H:%M:%S') as alert_time, source, risk_level,
               predicted_label, {sql_suggestion("low_text", "low_label", "risk_level")} as suggestion
        from (select * from alerts order by alert_ts desc nulls last, incident_id limit 50) t
        """,
        "alerts",
    ),
)
def alert_feed(spark, sf_dir):
    feed = ops.alert_feed(views.alerts(spark, sf_dir), 50)
    return feed.select(
        "incident_id",
        F.date_format("alert_ts", "yyyy-MM-dd HH:mm:ss").alias("alert_time"),
        "source",
        "risk_level",
        "predicted_label",
        "suggestion",
    )


@query("agg7_level_counts", with_views("select risk_level, count(*) as n from alerts group by 1", "alerts"))
def level_counts(spark, sf_dir):
    return ops.level_counts(views.alerts(spark, sf_dir))


_SUMMARY = """
    select 'Live alert feed: ' || sum(n) || ' total alerts logged.' || chr(10) || 'Current breakdown: '
           || string_agg(risk_level || '=' || n, ', ' order by pos) as summary
    from (select risk_level, count(*) as n,
                 list_position(['critical', 'high', 'medium', 'low'], risk_level) as pos
          from alerts group by risk_level) t
"""


@query("agg8_level_summary", with_views(_SUMMARY, "alerts"))
def level_summary(spark, sf_dir):
    return ops.level_summary(views.alerts(spark, sf_dir))


@query(
    "agg9_filtered_alerts",
    with_views(
        """
        select incident_id, risk_level, source from alerts where risk_level = 'critical' and source = 'error'
        """,
        "alerts",
    ),
)
def filtered_alerts(spark, sf_dir):
    return ops.filter_alerts(views.alerts(spark, sf_dir), "critical", "error").select(
        "incident_id", "risk_level", "source"
    )


@query(
    "agg9_alert_facets",
    with_views(
        """
        select 'level' as facet, risk_level as value, count(*) as n from alerts group by risk_level
        union all select 'source', source, count(*) from alerts group by source
        union all select 'all', 'all', count(*) from alerts
        """,
        "alerts",
    ),
)
def alert_facets(spark, sf_dir):
    return ops.alert_facets(views.alerts(spark, sf_dir))


@query(
    "agg14_digest_context",
    with_views(
        """
        select 'Loaded dataset: ' || (select count(*) from labelled) || ' reports across ['''
               || (select string_agg(domain, ''', ''' order by n desc, domain)
                   from (select domain, count(*) as n from labelled group by domain) d)
               || '''] with ' || (select count(distinct label) from labelled) || ' anomaly classes.'
               || chr(10) || (select summary from summarised) as context
        """,
        "alerts",
        summarised=_SUMMARY,
    ),
)
def digest_context(spark, sf_dir):
    line = audit.digest_line(views.labelled(spark, sf_dir))
    return ops.digest_context(line, views.alerts(spark, sf_dir))
