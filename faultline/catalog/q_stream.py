"""Queries that run a stream to its end; their SQL is the batch form of the same rows."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from faultline import schema
from faultline.catalog import query, views
from faultline.catalog.q_alerts import _ACCIDENT_ROWS, _FAULT_ROWS
from faultline.catalog.q_model import _evidence_sql, prepared
from faultline.catalog.views import (
    quoted,
    sql_incident_risk,
    sql_snippet,
    sql_strip,
    with_views,
)
from faultline.operators import features, retrieval
from faultline.session import files_in, materialise, replace_file, shared_folder
from faultline.sources import dropfiles, feeds
from faultline.streaming import monitor

# One line per document in a file named after its source; half of the files put the id last.
_DROP_LINES = f"""
    select source || '.csv' as file_name, doc_id + 1 as pos,
           case when ends_with(source, '1') or ends_with(source, '3')
                then regexp_replace(text, '[\\r\\n]', ' ', 'g')
                else (case when doc_id % 9 = 0 then '' else 'D' || doc_id end) || ','
                     || regexp_replace(text, '[\\r\\n]', ' ', 'g') end as line
    from documents
"""


def _fields_sql(line: str) -> str:
    field, quoted_field = quoted(dropfiles.FIELD), quoted(dropfiles.QUOTED_FIELD)
    return f"""
        list_transform(regexp_extract_all(',' || {line}, {field}, 1),
            lambda f: trim(case when regexp_matches(f, {quoted_field})
                                then replace(regexp_extract(f, {quoted_field}, 1), '""', '"')
                                     || regexp_extract(f, {quoted_field}, 2)
                                else f end, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))
    """


@query(
    "src6_drop_file_rows",
    with_views(
        f"""
        select file_name, pos, incident_id, narrative from (
            select file_name, pos,
                   coalesce(case when not plain then nullif(f[1], '') end,
                            regexp_replace(file_name, '\\.[^.]*$', '') || '-row' || pos) as incident_id,
                   array_to_string(list_filter(case when plain then f else f[2:] end, lambda x: x <> ''), ' ')
                   as narrative
            from (select *, {_fields_sql("line")} as f,
                         regexp_matches(file_name, '[13]\\.csv$') as plain from drop_lines) t) u
        where narrative <> '' and lower(narrative) not in ('nan', 'none')
        """,
        "incidents",
        drop_lines=_DROP_LINES,
    ),
)
def drop_file_rows(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    flat = F.regexp_replace("text", r"[\r\n]", " ")
    plain = F.col("source").endswith("1") | F.col("source").endswith("3")
    given = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(F.lit("D"), "doc_id"))
    name = F.concat("source", F.lit(".csv"))
    rows = docs.select(
        name.alias("file_path"),
        name.alias("file_name"),
        (F.col("doc_id") + 1).alias("pos"),
        F.when(plain, flat).otherwise(F.concat(given, F.lit(","), flat)).alias("line"),
    )
    headers = docs.groupBy("source").agg(F.lit(0).cast("bigint").alias("pos")).select(
        name.alias("file_path"),
        name.alias("file_name"),
        "pos",
        F.when(plain, "Report").otherwise("id, Narrative").alias("line"),
    )
    return dropfiles.parse_lines(headers.unionByName(rows))


@query(
    "src7_text_reports",
    f"select 'D' || doc_id || '.txt' as incident_id, {sql_strip('text')} as narrative from documents "
    f"where {sql_strip('text')} <> ''",
)
def text_reports(spark, sf_dir):
    docs = views.documents(spark, sf_dir)
    files = docs.select(F.col("text").alias("value"), F.concat(F.lit("D"), "doc_id", F.lit(".txt")).alias("file_name"))
    return dropfiles.txt_incidents(files).select("incident_id", "narrative")


@query(
    "str2_watched_folder_alerts",
    with_views(
        f"""
        select 'INC-' || incident_id as incident_id, risk_level, {sql_snippet("narrative", schema.ALERT_CHARS)} as narrative
        from (select incident_id, {sql_strip("narrative")} as narrative,
                     {sql_incident_risk(f"lower({sql_strip('narrative')})", "''")} as risk_level
              from incidents where narrative is not null) t
        where risk_level in ('critical', 'high')
        """,
        "incidents",
    ),
)
def watched_folder_alerts(spark, sf_dir):
    """CSV files written from the incidents, line breaks and all, picked up by the monitor's folder source."""
    root = shared_folder(spark, "watched")
    rows = views.incidents(spark, sf_dir).select(
        F.concat(F.lit("INC-"), "incident_id").alias("id"),
        "narrative",
    )
    rows.write.options(header=True, quote='"', escape='"', emptyValue="").csv(f"{root}/drop")
    monitor.scan_once(spark, [monitor.watch_feed(f"{root}/drop")], monitor.unlabelled_scorer, root)
    return monitor.read_alerts(spark, root).select("incident_id", "risk_level", "narrative")


@query(
    "str1_changed_files",
    with_views(
        f"""
        select 'INC-' || incident_id as incident_id, risk_level, {sql_snippet("narrative", schema.ALERT_CHARS)} as narrative,
               case when incident_id % 3 = 0 then 1 else 2 end as scan
        from (select *, {sql_incident_risk("lower(narrative)", "''")} as risk_level
              from (select incident_id, {sql_strip("narrative")} as narrative from incidents where narrative is not null) i) t
        where risk_level in ('critical', 'high')
        """,
        "incidents",
    ),
)
def changed_files(spark, sf_dir):
    """A third of the incidents first, then the same files with all of them: each row alerts once.

    Documentation and a hidden file lie in the folder too and give nothing.
    """
    root = shared_folder(spark, "grown")
    rows = views.incidents(spark, sf_dir).select(F.concat(F.lit("INC-"), "incident_id").alias("id"), "narrative", "incident_id")
    rows = materialise(rows.repartition("incident_id"), "grown-rows")
    noise = rows.limit(1).select(F.lit("INC-noise").alias("id"), F.lit("engine fire and collision").alias("narrative"))
    feed = monitor.watch_feed(f"{root}/drop", changed_files=True)

    def drop(part, names):
        part.write.options(header=True, quote='"', escape='"', emptyValue="").csv(f"{root}/landed/{names}")
        for i, file in enumerate(files_in(spark, f"{root}/landed/{names}", ".csv")):
            replace_file(spark, file, f"{root}/drop/{names.split('-')[0]}{i or ''}.csv")

    drop(noise, "readme"), drop(noise, ".hidden")
    for scan, part in enumerate((rows.filter("incident_id % 3 = 0"), rows), 1):
        drop(part.select("id", "narrative"), f"reports-{scan}")
        monitor.scan_once(spark, [feed], monitor.unlabelled_scorer, root)
    alerts = monitor.read_alerts(spark, root)
    return alerts.select("incident_id", "risk_level", "narrative", (F.col("batch") + 1).cast("int").alias("scan"))


@query(
    "str6_fault_stream_alerts",
    with_views(
        f"""
        select incident_id, risk_level, {sql_snippet("narrative", schema.ALERT_CHARS)} as narrative, source from (
            select *, case when base = 'medium' and risk_floor = 'high' then 'high' else base end as risk_level
            from (select *, {sql_incident_risk("lower(narrative)", "''")} as base from fault_rows) t) u
        where risk_level in ('critical', 'high')
        """,
        "faults",
        fault_rows=_FAULT_ROWS,
    ),
)
def fault_stream_alerts(spark, sf_dir):
    """Orders streamed in as fault records, deduplicated, scored and logged."""
    root = shared_folder(spark, "faults")
    customer = views.table(spark, sf_dir, "customer")
    feed = monitor.Feed(
        "faults",
        lambda session: views.table_stream(session, sf_dir, "orders"),
        lambda batch: feeds.fault_incidents(views.seed_faults(batch, customer)),
    )
    monitor.scan_once(spark, [feed], monitor.unlabelled_scorer, root)
    return monitor.read_alerts(spark, root).select("incident_id", "risk_level", "narrative", "source")


@query(
    "str5_accident_stream_alerts",
    with_views(
        f"""
        select incident_id, risk_level, {sql_snippet("narrative", schema.ALERT_CHARS)} as narrative, source from (
            select *, {sql_incident_risk("lower(narrative)", "''")} as risk_level from accident_rows) t
        where risk_level in ('critical', 'high')
        """,
        "accidents",
        accident_rows=_ACCIDENT_ROWS,
    ),
)
def accident_stream_alerts(spark, sf_dir):
    """Parts streamed in as accident records."""
    root = shared_folder(spark, "accidents")
    nation = views.table(spark, sf_dir, "nation")
    feed = monitor.Feed(
        "accidents",
        lambda session: views.table_stream(session, sf_dir, "part"),
        lambda batch: feeds.accident_incidents(views.seed_accidents(batch, nation)),
    )
    monitor.scan_once(spark, [feed], monitor.unlabelled_scorer, root)
    return monitor.read_alerts(spark, root).select("incident_id", "risk_level", "narrative", "source")


@query(
    "str8_scan_counts",
    with_views(
        """
        select 1 as scan, count(*) as new_incidents from fault_rows
        union all select 2, 0
        """,
        "faults",
        fault_rows=_FAULT_ROWS,
    ),
)
def scan_counts(spark, sf_dir):
    """New incidents of two passes over the same feed: a second pass finds none."""
    root = shared_folder(spark, "scans")
    customer = views.table(spark, sf_dir, "customer")
    feed = monitor.Feed(
        "faults",
        lambda session: views.table_stream(session, sf_dir, "orders"),
        lambda batch: feeds.fault_incidents(views.seed_faults(batch, customer)),
    )
    found = [monitor.scan_once(spark, [feed], monitor.unlabelled_scorer, root) for _ in range(2)]
    return spark.createDataFrame(list(enumerate(found, 1)), "scan int, new_incidents bigint")


@query(
    "str10_feed_cadence",
    with_views(
        f"""
        select 'accidents' as feed, {schema.ACCIDENT_FEED_SECONDS} as seconds, count(distinct incident_id) as new_incidents
        from accident_rows
        union all select 'faults', {schema.FAULT_FEED_SECONDS}, count(distinct incident_id) from fault_rows
        """,
        "accidents",
        "faults",
        accident_rows=_ACCIDENT_ROWS,
        fault_rows=_FAULT_ROWS,
    ),
)
def feed_cadence(spark, sf_dir):
    """Both feeds side by side, each on its own trigger, until what is there has been handled."""
    root = shared_folder(spark, "cadence")
    nation, customer = (views.table(spark, sf_dir, name) for name in ("nation", "customer"))

    def stream(name):
        return lambda session: views.table_stream(session, sf_dir, name)

    accidents = monitor.Feed(
        "accidents",
        stream("part"),
        lambda batch: feeds.accident_incidents(views.seed_accidents(batch, nation)),
        schema.ACCIDENT_FEED_SECONDS,
    )
    faults = monitor.Feed(
        "faults",
        stream("orders"),
        lambda batch: feeds.fault_incidents(views.seed_faults(batch, customer)),
        schema.FAULT_FEED_SECONDS,
    )
    found = []
    running = monitor.run(
        spark, [accidents, faults], monitor.unlabelled_scorer, root, lambda feed, batch, n: found.append((feed, n))
    )
    for one in running:
        # the first trigger takes all there is; the next one is a pace away
        while one.isActive and one.lastProgress is None:
            time.sleep(0.2)
        one.stop()
    paces = [(feed.name, feed.seconds) for feed in (accidents, faults)]
    paces = spark.createDataFrame(paces, "feed string, seconds int")
    counts = spark.createDataFrame(found, "feed string, n bigint").groupBy("feed").agg(F.sum("n").alias("new_incidents"))
    return paces.join(counts, "feed")


@query(
    "str7_scored_stream_alerts",
    with_views(
        f"""
        select incident_id, risk_level, predicted_label, evidence_label, evidence_id_count from (
            select 'B' || query_id as incident_id, any_value(label) filter (where rank = 1) as predicted_label,
                   any_value(label) filter (where rank = 2) as evidence_label, count(*) as evidence_id_count,
                   any_value(a.narrative) as narrative,
                   {sql_incident_risk("lower(any_value(a.narrative))", "lower(any_value(label) filter (where rank = 1))")}
                   as risk_level
            from ranked r join asked a using (query_id) group by query_id) t
        where risk_level in ('critical', 'high')
        """,
        "clean",
        **_evidence_sql(
            "select item_id as query_id, text as narrative from benchmark",
            "select * from clean",
            schema.EVIDENCE_TOP_K,
            sql_snippet("c.narrative", schema.EVIDENCE_CHARS),
        ),
    ),
)
def scored_stream_alerts(spark, sf_dir):
    """New reports streamed in; the nearest past incident's label is the prediction."""
    root = shared_folder(spark, "reports")
    corpus = prepared(spark, sf_dir)
    model = features.fit_tfidf(corpus)
    retrieval.save_index(retrieval.build_index(corpus, model), f"{root}/index")

    def score(new):
        index = retrieval.load_index(spark, f"{root}/index")
        explained = retrieval.explain(new, index, model, id_col="key")
        return explained.withColumn("predicted_label", F.get("evidence", F.lit(0))["label"])

    def to_incidents(batch):
        key = F.concat(F.lit("B"), "item_id")
        return batch.select(
            key.alias("key"),
            key.alias("incident_id"),
            F.lit("benchmark").alias("source"),
            F.col("text").alias("narrative"),
            F.lit(None).cast("string").alias("risk_floor"),
        )

    feed = monitor.Feed(
        "reports",
        lambda session: views.table_stream(session, sf_dir, "benchmark"),
        to_incidents,
    )
    monitor.scan_once(spark, [feed], score, root)
    evidence = F.from_json("evidence_json", schema.EVIDENCE)
    return monitor.read_alerts(spark, root).select(
        "incident_id",
        "risk_level",
        "predicted_label",
        F.get(evidence, F.lit(1))["label"].alias("evidence_label"),
        F.size(evidence).cast("bigint").alias("evidence_id_count"),
    )


@query("str3_stream_duplicates", "select distinct sha1(text)[1:16] as key from documents")
def stream_duplicates(spark, sf_dir):
    """Keys of a stream of texts with Spark's state dropping the ones seen before."""
    root = shared_folder(spark, "dedupe")
    docs = views.table_stream(spark, sf_dir, "documents")
    keyed = docs.select(F.left(F.sha1("text"), F.lit(16)).alias("key"))
    (
        monitor.drop_seen(keyed)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/keys")
        .awaitTermination()
    )
    return spark.read.parquet(f"{root}/keys")


@query(
    "str3_watermarked_duplicates",
    "select distinct event_type || '-' || user_id as key from events",
)
def watermarked_duplicates(spark, sf_dir):
    """Keys of the event stream with state that is let go once a key is a day old."""
    root = shared_folder(spark, "dedupe-within")
    events = views.table_stream(spark, sf_dir, "events")
    keyed = events.select(
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    (
        monitor.drop_seen(keyed, time_col="ts", within="1 day")
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/keys")
        .awaitTermination()
    )
    return spark.read.parquet(f"{root}/keys").select("key")


@query(
    "str4_appended_rows",
    with_views(
        """
        select 'ds-row-' || incident_id as key from labelled
        where trim(narrative, ' ') <> '' and domain = 'Power Grid'
        """,
        "labelled",
    ),
)
def appended_rows(spark, sf_dir):
    """The aviation rows are there at the first run; the power rows are appended and handled."""
    root = shared_folder(spark, "appended")
    rows = views.labelled(spark, sf_dir)
    path = f"{root}/table"
    feed = monitor.table_feed(path, rows.schema)
    rows.filter(F.col("domain") == schema.AVIATION).write.parquet(path)
    monitor.set_baseline(spark, feed, root)
    rows.filter(F.col("domain") == schema.POWER).write.mode("append").parquet(path)
    monitor.scan_once(spark, [feed], monitor.unlabelled_scorer, root)
    return monitor.read_seen(spark, root).filter("risk_level is not null").select("key")


@query(
    "str12_hourly_counts",
    """
    select strftime(hour_start, '%Y-%m-%d %H:%M:%S') as hour_start, event_type, n from (
        select date_trunc('hour', ts) as hour_start, event_type, count(*) as n from events group by 1, 2) t
    """,
)
def hourly_counts(spark, sf_dir):
    """Every hour of a finite stream: in complete mode no hour is held back and no late row left out."""
    root = shared_folder(spark, "hourly")
    stream = views.table_stream(spark, sf_dir, "events")
    (
        monitor.hourly_counts(stream, "ts", "event_type")
        .writeStream.outputMode("complete")
        .foreachBatch(lambda counts, _: counts.write.mode("overwrite").parquet(f"{root}/counts"))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    counts = spark.read.parquet(f"{root}/counts")
    return counts.withColumn("hour_start", F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss"))
