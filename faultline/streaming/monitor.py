"""The monitor: one streaming query per source, each scoring new incidents and logging alerts.

Layout below a root folder that all executors reach:

    checkpoints/<feed>            progress of the feed's query
    claims, ledger                keys handled so far, see `ledger`
    seen/feed=<feed>/batch=<n>    key, risk level and alert flag of every incident handled
    alerts/feed=<feed>/batch=<n>  the alert log

A batch replaces its own folders and ignores ledger entries of itself and later ones, so running
it again after a failure gives the same files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline import schema
from faultline.functions.risk import with_incident_risk
from faultline.functions.text import content_key, snippet, strip
from faultline.operators.classifier import TrainedModel
from faultline.operators.cleaning import keep_first
from faultline.operators.features import add_processed
from faultline.operators.retrieval import explain, load_index
from faultline.session import materialise, path_exists, scratch
from faultline.sources import dropfiles, feeds, watchfolder
from faultline.sources.alerts import to_log_rows
from faultline.streaming import ledger

Scorer = Callable[[DataFrame], DataFrame]
SEEN_LAYOUT = "key string, risk_level string, is_alert boolean, feed string, batch bigint"


@dataclass
class Feed:
    """A source of the monitor: its raw stream and how a batch of it becomes incidents."""

    name: str
    stream: Callable[[SparkSession], DataFrame]
    to_incidents: Callable[[DataFrame], DataFrame]
    seconds: int = schema.LOOP_SECONDS
    baseline: bool = False


def watch_feed(
    folder: str, name: str = "watch", max_files: int | None = None, changed_files: bool = False
) -> Feed:
    """CSV and TXT files dropped into a folder. A file is read once, under the name it came with.

    With `changed_files` a file that has grown or was replaced is read again and its new rows are handled.
    `max_files` bounds a batch of the other form when a large backlog is waiting.
    """
    if changed_files:
        return Feed(name, lambda spark: watchfolder.watched_stream(spark, folder), dropfiles.mixed_incidents)
    return Feed(name, lambda spark: dropfiles.mixed_stream(spark, folder, max_files), dropfiles.mixed_incidents)


def accident_feed(path: str, name: str = "accidents") -> Feed:
    return Feed(
        name,
        lambda spark: feeds.read_feed(spark, path, "accident", stream=True),
        feeds.accident_incidents,
        schema.ACCIDENT_FEED_SECONDS,
    )


def fault_feed(path: str, name: str = "faults") -> Feed:
    return Feed(
        name,
        lambda spark: feeds.read_feed(spark, path, "fault", stream=True),
        feeds.fault_incidents,
        schema.FAULT_FEED_SECONDS,
    )


def table_feed(path: str, layout, name: str = "dataset", id_col: str = "incident_id") -> Feed:
    """Rows added to the incident table; those there at the first run only set the baseline."""

    def to_incidents(rows: DataFrame) -> DataFrame:
        key = F.concat(F.lit("ds-row-"), F.col(id_col).cast("string"))
        return rows.filter("trim(narrative) <> ''").select(
            key.alias("key"),
            key.alias("incident_id"),
            F.lit("dataset").alias("source"),
            "narrative",
            F.lit(None).cast("string").alias("risk_floor"),
        )

    return Feed(name, lambda spark: spark.readStream.schema(layout).parquet(path), to_incidents, baseline=True)


def model_scorer(spark: SparkSession, trained: TrainedModel, index_path: str, k: int = schema.EVIDENCE_TOP_K) -> Scorer:
    """Predicted label and evidence; the newest complete index version is read for every batch."""

    def score(new: DataFrame) -> DataFrame:
        predicted = trained.predict(add_processed(new)).drop("processed_text")
        index = load_index(spark, index_path)
        return explain(predicted, index, trained.vectoriser, k=k, id_col="key")

    return score


def unlabelled_scorer(new: DataFrame) -> DataFrame:
    """No model: the risk comes from the words of the narrative alone."""
    return new.withColumns(
        {"predicted_label": F.lit("").cast("string"), "evidence": F.array().cast(schema.EVIDENCE)}
    )


def first_of_each_key(incidents: DataFrame) -> DataFrame:
    """One incident per key, the first to arrive; a missing key is made of the content.

    Keys are counted without their texts; only incidents whose key occurs more than once are brought together.
    """
    if "arrival" not in incidents.columns:
        incidents = incidents.withColumn("arrival", F.lit(""))
    key = F.coalesce(F.nullif("key", F.lit("")), content_key(F.col("narrative")))
    keyed = materialise(incidents.withColumn("key", key), "keyed-incidents")
    counted = keyed.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
    repeated = materialise(counted.select(F.col("key").alias("_key")), "repeated-keys")
    # A null key, of an incident without narrative, is one key.
    same = F.col("key").eqNullSafe(F.col("_key"))
    copies = keep_first(keyed.join(repeated, same, "left_semi"), "key", ["arrival", "narrative"])
    single = keyed.join(repeated, same, "left_anti")
    return single.unionByName(materialise(copies, "first-incidents")).drop("arrival")


def drop_seen(stream: DataFrame, key: str = "key", time_col: str | None = None, within: str | None = None) -> DataFrame:
    """Duplicates dropped inside a stream by Spark's own state: for ever, or within a time bound.

    For streams that end elsewhere than in the alert log. Every row travels to the task that holds
    its key's state; the monitor itself reduces a batch to one row per key before it shuffles.
    """
    if within is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark([key])


def read_seen(spark: SparkSession, root: str) -> DataFrame:
    folder = f"{root}/seen"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], SEEN_LAYOUT)
    return spark.read.schema(SEEN_LAYOUT).parquet(folder)


def read_alerts(spark: SparkSession, root: str) -> DataFrame:
    folder = f"{root}/alerts"
    layout = ", ".join(f"{field.name} string" for field in schema.ALERT_LOG) + ", feed string, batch bigint"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], layout)
    return spark.read.schema(layout).parquet(folder)


def score_incidents(new: DataFrame, scorer: Scorer) -> DataFrame:
    """Predicted label, evidence, risk with floor, snippet and alert flag of new incidents."""
    scored = with_incident_risk(scorer(new), label="predicted_label", floor="risk_floor")
    return scored.withColumns(
        {
            "narrative": snippet(strip(F.col("narrative")), schema.ALERT_CHARS),
            "incident_id": F.coalesce("incident_id", F.lit("manual")),
            "source": F.coalesce("source", F.lit("manual")),
            "alert_ts": F.current_timestamp(),
        }
    )


def handle_batch(batch: DataFrame, batch_id: int, feed: Feed, scorer: Scorer, root: str) -> int:
    """Take on the new incidents of one batch, score them, log the alerts; the number of new ones."""
    spark = batch.sparkSession
    place = f"feed={feed.name}/batch={batch_id}"
    counted = Observation()
    with scratch(spark):
        new = ledger.claim(first_of_each_key(feed.to_incidents(batch)), root, feed.name, batch_id)
        scored = materialise(score_incidents(new, scorer).observe(counted, F.count(F.lit(1)).alias("n")), "scored-incidents")
        to_log_rows(scored.filter("is_alert")).write.mode("overwrite").parquet(f"{root}/alerts/{place}")
        scored.select("key", "risk_level", "is_alert").write.mode("overwrite").parquet(f"{root}/seen/{place}")
    ledger.compact(spark, root)
    return counted.get.get("n", 0)


def note_batch(batch: DataFrame, batch_id: int, feed: Feed, root: str) -> None:
    """Enter the incidents of a baseline batch in the ledger, unscored."""
    with scratch(batch.sparkSession):
        keys = materialise(first_of_each_key(feed.to_incidents(batch)).select("key"), "baseline-keys")
        ledger.claim(keys, root, f"{feed.name}-baseline", batch_id)
        noted = keys.withColumns({"risk_level": F.lit(None).cast("string"), "is_alert": F.lit(False)})
        noted.write.mode("overwrite").parquet(f"{root}/seen/feed={feed.name}-baseline/batch={batch_id}")


def _writer(spark: SparkSession, feed: Feed, root: str, handle: Callable[[DataFrame, int], None]):
    return (
        feed.stream(spark)
        .writeStream.queryName(f"monitor-{feed.name}")
        .foreachBatch(handle)
        .option("checkpointLocation", f"{root}/checkpoints/{feed.name}")
    )


def set_baseline(spark: SparkSession, feed: Feed, root: str) -> None:
    """Take note of everything a feed holds now; done once, and again if it did not complete."""
    done = f"{root}/baselines/{feed.name}"
    if path_exists(spark, f"{done}/_SUCCESS"):
        return
    noting = _writer(spark, feed, root, lambda batch, batch_id: note_batch(batch, batch_id, feed, root))
    noting.trigger(availableNow=True).start().awaitTermination()
    spark.range(1).write.mode("overwrite").parquet(done)


def start(
    spark: SparkSession,
    feed: Feed,
    scorer: Scorer,
    root: str,
    once: bool = False,
    report: Callable[[str, int, int], None] | None = None,
) -> StreamingQuery:
    """Start one feed's query; `once` works off what is there and stops.

    `report` is told feed, batch and number of new incidents of every batch handled.
    """
    if feed.baseline:
        set_baseline(spark, feed, root)
    trigger = {"availableNow": True} if once else {"processingTime": f"{feed.seconds} seconds"}

    def handle(batch: DataFrame, batch_id: int) -> None:
        found = handle_batch(batch, batch_id, feed, scorer, root)
        if report is not None:
            report(feed.name, batch_id, found)

    return _writer(spark, feed, root, handle).trigger(**trigger).start()


def scan_once(spark: SparkSession, sources: list[Feed], scorer: Scorer, root: str) -> int:
    """One pass over all sources; the number of incidents that were new, as the batches observed it."""
    found: list[int] = []
    for feed in sources:
        start(spark, feed, scorer, root, True, lambda _, __, n: found.append(n)).awaitTermination()
    return sum(found)


def run(
    spark: SparkSession,
    sources: list[Feed],
    scorer: Scorer,
    root: str,
    report: Callable[[str, int, int], None] | None = None,
) -> list[StreamingQuery]:
    """All sources side by side, each at its own pace, until stopped."""
    return [start(spark, feed, scorer, root, report=report) for feed in sources]


def hourly_counts(alerts: DataFrame, time_col: str, level: str, late: str = "10 minutes") -> DataFrame:
    """Counts per level and hour of a stream (or table) of alerts, late rows within a bound."""
    timed = alerts.withColumn(time_col, F.col(time_col).cast("timestamp"))
    if alerts.isStreaming:
        timed = timed.withWatermark(time_col, late)
    counted = timed.groupBy(F.window(time_col, "1 hour").alias("hour"), F.col(level)).agg(F.count("*").alias("n"))
    return counted.select(F.col("hour.start").alias("hour_start"), level, "n")
