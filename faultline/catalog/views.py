"""Test views over the given tables, once as Spark frames and once as common table expressions.

The given texts hold none of the words the risk scores look for, so each incident gets a phrase
and a label chosen from its id; the class sizes are skewed (2k+1 of every 400 ids).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema

PHRASES = [
    "engine fire at FL350, declared emergency",
    "unplanned power cut affecting 250 customers",
    "wind shear and turbulence on approach",
    "routine preflight checks completed",
    "bird strike during takeoff roll",
    "lost communication with atc due to static",
    "runway incursion while taxiing",
    "hurricane outage on transmission line",
    "fuel leak and crew fatigue",
    "passenger unruly in cabin",
    "load shed after grid oscillation",
    "altitude overshoot due to workload",
    "underground cable fault at substation",
    "arctic cold weather event",
    "medical illness reported",
    "tcas resolution advisory in cruise",
    "smoke odor in cockpit",
    "solar pv disturbance",
    "unstable approach long landing",
    "paperwork completed",
]
LABELS = [
    "Aircraft Equipment Problem Critical",
    "ATC Issue All Types",
    "Conflict NMAC",
    "Deviation - Altitude Overshoot",
    "Deviation - Speed All Types",
    "Flight Deck / Cabin Event Passenger Misconduct",
    "Ground Incursion Runway",
    "Inflight Event Bird / Animal",
    "Inflight Event Weather / Turbulence",
    "Inflight Event Fuel Issue",
    # Names of the published grid event reports, as their labels have them.
    "Power Grid - Northeast Blackout 2003",
    "Power Grid - Hurricane Sandy",
    "Power Grid - San Fernando Disturbance",
    "Power Grid - January 11 Oscillation Event",
    "Power Grid - South Central Cold Weather",
    "Power Grid - Solar PV Disturbance 2018",
    "Power Grid - Northeast Snowstorm 2011",
    "Power Grid - January 2025 Arctic Events",
    "No Specific Anomaly Occurred",
    "Ground Event Other",
]
QUESTIONS = [
    "",
    "summary, please",
    "Which problems do the records have?",
    "how complete is the table, and are there duplicates? any data quality worries?",
    "Which kinds of report are dangerous or critical?",
    "class sizes?",
    "analyze smoke in the galley after a bird strike",
    "analyze",
    "good morning",
    "Is the grid safety record getting better?",
]
KEPT_LABELS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream, whether it is one file or a folder of part files.

    Written as a pattern that matches the one name: a plain path would have to be a folder.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _item(items: list[str], index: Column) -> Column:
    return F.element_at(F.lit(items), index.cast("int") + 1)


def seed_incidents(documents: DataFrame) -> DataFrame:
    """The incidents view over a documents frame, batch or stream."""
    k = F.floor(F.sqrt(F.col("doc_id") % 400))
    seeded = documents.select("doc_id", "text", k.alias("k"))
    label = F.concat(_item(LABELS, F.col("k")), F.lit("; "), _item(LABELS, (F.col("k") + 3) % 20))
    return seeded.select(
        F.col("doc_id").alias("incident_id"),
        F.when(F.col("doc_id") % 41 == 0, F.lit(None))
        .when(F.col("doc_id") % 43 == 0, "Short note.")
        .otherwise(F.concat(_item(PHRASES, F.col("k")), F.lit(". "), F.col("text")))
        .alias("narrative"),
        F.when(F.col("doc_id") % 37 == 0, F.lit(None)).otherwise(label).alias("label_raw"),
        F.when(F.col("k").between(10, 17), schema.POWER).otherwise(schema.AVIATION).alias("domain"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_incidents(documents(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with their primary label as `label`."""
    from faultline.operators.cleaning import primary_label

    return incidents(spark, sf_dir).select(
        "incident_id", "narrative", primary_label(F.col("label_raw")).alias("label"), "domain"
    )


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean incident table: bucketing, row filters and narrative dedupe over both domains."""
    from faultline.operators.cleaning import merge_domains, primary_label

    rows = incidents(spark, sf_dir).withColumnRenamed("label_raw", "label")
    power = rows.filter(F.col("domain") == schema.POWER)
    return merge_domains(
        rows.filter(F.col("domain") == schema.AVIATION),
        power.withColumn("label", primary_label(F.col("label"))),
        k=KEPT_LABELS,
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin of the alert log: scored incidents with an event's time and type."""
    from faultline.functions.risk import with_incident_risk

    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("incident_id"),
        F.col("ts").cast("timestamp").alias("alert_ts"),
        F.col("event_type").alias("source"),
    )
    scored = with_incident_risk(labelled(spark, sf_dir)).withColumnRenamed("label", "predicted_label")
    return scored.join(events, "incident_id")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("report_id"), F.col("source").alias("label"), "text"
    )


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    return seed_faults(orders, customer)


def seed_faults(orders: DataFrame, customer: DataFrame) -> DataFrame:
    status = F.col("o_orderstatus")
    return orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").cast("string").alias("incidentreference"),
        F.when(status == "F", "Unplanned").when(status == "O", "Planned").otherwise("Restored").alias("powercuttype"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "")
        .otherwise(F.concat(F.lit("Fault on feeder "), "o_orderpriority", F.lit(".")))
        .alias("mainmessage"),
        F.col("c_mktsegment").alias("operatingzone"),
        (F.col("o_custkey") % 300).cast("int").alias("nocustomeraffected"),
    )


def accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_accidents(table(spark, sf_dir, "part"), table(spark, sf_dir, "nation"))


def seed_accidents(part: DataFrame, nation: DataFrame) -> DataFrame:
    return part.join(nation, F.col("n_nationkey") == F.col("p_partkey") % 25).select(
        F.col("p_partkey").cast("string").alias("ev_id"),
        F.col("p_brand").alias("acft_make"),
        F.col("p_name").alias("acft_model"),
        F.col("n_name").alias("ev_city"),
        F.when(F.col("p_size") > 25, "FATL").alias("ev_highest_injury"),
        F.when(F.col("p_partkey") % 7 == 0, "")
        .otherwise(F.concat(F.lit("Loss of engine power on "), "p_type"))
        .alias("probable_cause"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = _item(QUESTIONS, (F.col("conv_id") * 7 + F.col("turn")) % 10)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", picked.alias("query"), "text")


# Path forms a log line may hold; {u} is the user and {e} the event type.
LOG_FORMS = [
    "/home/u{u}/tmp/{e} /var/log/{e}",
    "C:\\Users\\u{u}\\{e}.log failed",
    "\\srv/secret/",
    "kept in \\srv\\u{u}/share/{e}.txt, see log",
    "/Users/u{u}/{e} and more",
    "/workspace/{e}/u{u} at /tmp/{e}",
    "no path in {e}",
]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = _item(LOG_FORMS, F.col("event_id") % len(LOG_FORMS))
    named = F.replace(form, F.lit("{u}"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.replace(named, F.lit("{e}"), F.col("event_type")).alias("line"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(quoted(item) for item in items) + "]"


def sql_any(column: str, terms) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(term)})" for term in terms) + ")"


_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_strip(column: str) -> str:
    return f"trim({column}, {_STRIP})"


def sql_snippet(column: str, limit: int) -> str:
    return f"case when length({column}) > {limit} then left({column}, {limit}) || '...' else {column} end"


def sql_label_risk(low: str) -> str:
    from faultline.functions import lexicon

    return (
        f"case when {sql_any(low, lexicon.LABEL_CRITICAL)} then 'critical' "
        f"when {sql_any(low, lexicon.LABEL_HIGH)} then 'high' else 'medium' end"
    )


def sql_incident_risk(text: str, label: str) -> str:
    from faultline.functions import lexicon

    return (
        f"case when {sql_any(text, lexicon.TEXT_CRITICAL)} then 'critical' "
        f"when {sql_label_risk(label)} <> 'medium' then {sql_label_risk(label)} "
        f"when {sql_any(text, lexicon.TEXT_HIGH)} then 'high' else 'medium' end"
    )


def sql_categories(low: str, groups) -> str:
    cases = ", ".join(f"case when {sql_any(low, terms)} then {quoted(name)} end" for name, terms in groups.items())
    return f"list_filter([{cases}], lambda x: x is not null)"


# One entry per view: (views it reads, SQL). `with_views` puts the needed ones in order.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "incidents": (
        (),
        f"""
        select doc_id as incident_id,
               case when doc_id % 41 = 0 then null
                    when doc_id % 43 = 0 then 'Short note.'
                    else {sql_list(PHRASES)}[k + 1] || '. ' || text end as narrative,
               case when doc_id % 37 = 0 then null
                    else {sql_list(LABELS)}[k + 1] || '; ' || {sql_list(LABELS)}[(k + 3) % 20 + 1] end as label_raw,
               case when k between 10 and 17 then 'Power Grid' else 'Aviation' end as domain
        from (select *, cast(floor(sqrt(doc_id % 400)) as int) as k from documents) d
        """,
    ),
    "labelled": (
        ("incidents",),
        f"""
        select incident_id, narrative, {sql_strip("split_part(label_raw, ';', 1)")} as label, domain
        from incidents
        """,
    ),
    "bucketed": (
        ("labelled",),
        f"""
        select l.incident_id, l.narrative, l.domain,
               case when l.label is null or l.domain = 'Power Grid' then l.label
                    when l.label in (select label from labelled
                                     where domain = 'Aviation' and label <> 'Other'
                                     group by label order by count(*) desc, label limit {KEPT_LABELS})
                    then l.label else 'Other' end as label
        from labelled l
        """,
    ),
    "clean": (
        ("bucketed",),
        f"""
        select incident_id, narrative, label, domain
        from (select *, row_number() over (partition by narrative
                                           order by case when domain = 'Aviation' then 0 else 1 end, incident_id) rn
              from bucketed
              where narrative is not null and label is not null
                and length(narrative) > {schema.MIN_NARRATIVE_CHARS}) t
        where rn = 1
        """,
    ),
    "scored": (
        ("labelled",),
        f"""
        select *, {sql_incident_risk("low_text", "low_label")} as risk_level
        from (select *, lower(coalesce(narrative, '')) as low_text, lower(coalesce(label, '')) as low_label
              from labelled) t
        """,
    ),
    "alerts": (
        ("scored",),
        """
        select i.incident_id, i.narrative, i.label as predicted_label, i.domain, i.risk_level,
               i.low_text, i.low_label, e.ts as alert_ts, e.event_type as source
        from scored i join events e on e.event_id = i.incident_id
        """,
    ),
    "reports": ((), "select doc_id as report_id, source as label, text from documents"),
    "faults": (
        (),
        """
        select cast(o_orderkey as varchar) as incidentreference,
               case o_orderstatus when 'F' then 'Unplanned' when 'O' then 'Planned' else 'Restored' end as powercuttype,
               case when o_orderpriority = '4-NOT SPECIFIED' then ''
                    else 'Fault on feeder ' || o_orderpriority || '.' end as mainmessage,
               c_mktsegment as operatingzone,
               cast(o_custkey % 300 as int) as nocustomeraffected
        from orders join customer on c_custkey = o_custkey
        """,
    ),
    "accidents": (
        (),
        """
        select cast(p_partkey as varchar) as ev_id, p_brand as acft_make, p_name as acft_model, n_name as ev_city,
               case when p_size > 25 then 'FATL' end as ev_highest_injury,
               case when p_partkey % 7 = 0 then '' else 'Loss of engine power on ' || p_type end as probable_cause
        from part join nation on n_nationkey = p_partkey % 25
        """,
    ),
    "questions": (
        (),
        f"""
        select conv_id, turn, {sql_list(QUESTIONS)}[(conv_id * 7 + turn) % 10 + 1] as query, text
        from conversations
        """,
    ),
    "log_lines": (
        (),
        f"""
        select event_id, replace(replace({sql_list(LOG_FORMS)}[(event_id % {len(LOG_FORMS)}) + 1],
                                         '{{u}}', cast(user_id as varchar)), '{{e}}', event_type) as line
        from events
        """,
    ),
}


def with_views(body: str, *names: str, **extra: str) -> str:
    """SQL text with the named views and what they read in front; `extra` views come last."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} as ({VIEWS[name][1].strip()})" for name in ordered]
    parts += [f"{name} as ({text.strip()})" for name, text in extra.items()]
    return "with " + ",\n".join(parts) + "\n" + body.strip()
