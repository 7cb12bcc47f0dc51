"""The batch job: incidents, normalised text, training, evaluation, evidence, report tables.

    python -m faultline.plans.batch --root PATH [--aviation PATH] [--reports PATH] ...

Tables below the root folder: `incidents`, `prepared`, `model`, `index`, `predictions`,
`evaluation/*`, `explained`, `report/*`. Each stage reads what the one before it wrote.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions.text import snippet
from faultline.operators import audit, cleaning, evaluation, features, retrieval, split
from faultline.operators.classifier import TrainedModel, load_model, save_model, search_and_fit, training_record
from faultline.operators.requests import check_parameters
from faultline.session import build_session, read_latest, write_version
from faultline.sources.incidents import refresh, source_rows, with_fallback
from faultline.sources.reports import report_narratives
from faultline.streaming import monitor


def aviation_rows(rows: DataFrame, order_by: str = "row_idx", cap: int | None = None) -> DataFrame:
    picked = source_rows(rows, order_by, cap=cap)
    return picked.select(F.concat(F.lit("asrs-"), F.col(order_by).cast("string")).alias("incident_id"), "narrative", "label")


def power_rows(reports: DataFrame) -> DataFrame:
    chunks = report_narratives(reports)
    incident_id = F.concat_ws("-", F.col("report_id").cast("string"), F.col("chunk_no").cast("string"))
    return chunks.select(incident_id.alias("incident_id"), "narrative", "label")


def build_incidents(
    spark: SparkSession,
    root: str,
    aviation: DataFrame | None,
    reports: DataFrame | None,
    force: bool = False,
    k: int = schema.TOP_LABELS,
) -> DataFrame:
    """The stored incident table, rebuilt when absent or forced; a silent source falls back."""

    def build(cached: DataFrame | None) -> DataFrame:
        fresh = [
            cleaning.tag_domain(frame, domain)
            for frame, domain in (
                (aviation, schema.AVIATION),
                (None if reports is None else power_rows(reports), schema.POWER),
            )
            if frame is not None
        ]
        merged = None if not fresh else fresh[0] if len(fresh) == 1 else fresh[0].unionByName(fresh[1])
        kept = None if cached is None else cached.select("incident_id", "narrative", "label", "domain")
        rows = with_fallback(merged, kept)
        return cleaning.merge_domains(
            rows.filter(F.col("domain") == schema.AVIATION).drop("domain"),
            rows.filter(F.col("domain") == schema.POWER).drop("domain"),
            k,
        )

    return refresh(spark, f"{root}/incidents", build, force)


def prepare(spark: SparkSession, incidents: DataFrame, root: str) -> DataFrame:
    """Normalised text and the train/test split, written once."""
    write_version(features.add_processed(split.train_test(incidents)), f"{root}/prepared")
    return read_latest(spark, f"{root}/prepared")


def train(spark: SparkSession, prepared: DataFrame, root: str, **grid) -> TrainedModel:
    trained = search_and_fit(prepared.filter("split = 'train'"), **grid)
    sizes = prepared.groupBy("split").agg(F.count("*").alias("n")).collect()
    trained.config |= {f"n_{row['split']}": row["n"] for row in sizes}
    trained.config["test_size"] = schema.TEST_SHARE
    save_model(trained, spark, f"{root}/model")
    return trained


def evaluate(spark: SparkSession, prepared: DataFrame, trained: TrainedModel, root: str) -> DataFrame:
    """Predictions for the test rows and the tables derived from them."""
    predicted = trained.predict(prepared.filter("split = 'test'"))
    predicted.write.mode("overwrite").parquet(f"{root}/predictions")
    predicted = spark.read.parquet(f"{root}/predictions")
    pairs = evaluation.pair_counts(predicted)
    for name, frame in {
        "report": evaluation.classification_report(pairs),
        "confusion": evaluation.confusion_matrix(pairs),
        "metrics": evaluation.metrics(pairs),
        "top_support": evaluation.top_support(pairs),
        "dominant_domains": audit.dominant_domains(prepared),
    }.items():
        frame.write.mode("overwrite").parquet(f"{root}/evaluation/{name}")
    return predicted


def explain_sample(
    spark: SparkSession, prepared: DataFrame, predicted: DataFrame, trained: TrainedModel, root: str, samples: int
) -> DataFrame:
    """Evidence from the training rows for a sample of the test rows."""
    retrieval.save_index(
        retrieval.build_index(prepared.filter("split = 'train'"), trained.vectoriser), f"{root}/explain_index"
    )
    index = retrieval.load_index(spark, f"{root}/explain_index")
    sample = split.hash_sample(predicted, samples)
    explained = retrieval.explain(sample, index, trained.vectoriser).select(
        "incident_id",
        F.col("processed_text").alias("input"),
        snippet(F.col("processed_text"), schema.INPUT_CHARS).alias("input_snippet"),
        F.col("label").alias("true_label"),
        "predicted_label",
        (F.col("label") == F.col("predicted_label")).alias("correct"),
        "evidence",
    )
    explained.write.mode("overwrite").parquet(f"{root}/explained")
    return spark.read.parquet(f"{root}/explained")


def report_tables(
    incidents: DataFrame, pairs: DataFrame, record: DataFrame, explained: DataFrame | None, examples: int = 10
) -> dict[str, DataFrame]:
    """The data of the final report, one frame per section."""
    stats = audit.dataset_stats(incidents).select("total_reports", "anomaly_classes")
    tables = {
        "totals": audit.one_row(stats, evaluation.accuracy(pairs).select("accuracy")),
        "training": record,
        "domains": audit.domain_counts(incidents),
        "quality": audit.graded_audit(incidents),
        "top_classes": audit.class_distribution(incidents, 15),
        "class_rows": evaluation.classification_report(pairs).filter(
            ~F.col("class").isin("accuracy", "macro avg", "weighted avg")
        ),
    }
    if explained is not None:
        tables["examples"] = explained.orderBy("incident_id").limit(examples)
    return tables


def run_batch(
    spark: SparkSession,
    root: str,
    aviation: DataFrame | None = None,
    reports: DataFrame | None = None,
    force: bool = False,
    evidence: bool = True,
    samples: int = schema.EXPLAIN_SAMPLES,
    **grid,
) -> dict[str, DataFrame]:
    """All stages; returns the report tables, which are also written."""
    if samples <= 0:
        raise ValueError("samples must be positive")
    incidents = build_incidents(spark, root, aviation, reports, force)
    prepared = prepare(spark, incidents, root)
    trained = train(spark, prepared, root, **grid)
    predicted = evaluate(spark, prepared, trained, root)
    explained = explain_sample(spark, prepared, predicted, trained, root, samples) if evidence else None
    retrieval.save_index(retrieval.build_index(incidents, trained.vectoriser), f"{root}/index")
    tables = report_tables(
        incidents, evaluation.pair_counts(predicted), training_record(trained, spark), explained
    )
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{root}/report/{name}")
    return {name: spark.read.parquet(f"{root}/report/{name}") for name in tables}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Run the incident batch job.")
    parser.add_argument("--root", required=True, help="folder all executors reach")
    parser.add_argument("--aviation", help="landed source rows (Parquet with row_idx)")
    parser.add_argument("--reports", help="event report texts (Parquet: report_id, label, text)")
    parser.add_argument("--nrows", type=int, default=0, help="source rows to take at most, 0 for all")
    parser.add_argument("--force-refresh", action="store_true", help="rebuild the incident table")
    parser.add_argument("--no-fetch", action="store_true", help="use the stored incident table only")
    parser.add_argument("--no-rag", action="store_true", help="skip the evidence stage")
    parser.add_argument("--samples", type=int, default=schema.EXPLAIN_SAMPLES)
    parser.add_argument("--monitor", action="store_true", help="start the monitor afterwards")
    parser.add_argument("--watch-dir", help="folder the monitor watches")
    parser.add_argument("--poll", type=int, default=schema.LOOP_SECONDS)
    args = parser.parse_args(argv)
    spark = build_session()
    if args.no_fetch and read_latest(spark, f"{args.root}/incidents") is None:
        print(f"no stored incident table below {args.root}", file=sys.stderr)
        return 1
    landed = None if args.no_fetch or not args.aviation else spark.read.parquet(args.aviation)
    reports = None if args.no_fetch or not args.reports else spark.read.parquet(args.reports)
    run_batch(
        spark,
        args.root,
        None if landed is None else aviation_rows(landed, cap=args.nrows or None),
        reports,
        force=args.force_refresh,
        evidence=not args.no_rag,
        samples=args.samples,
    )
    if args.monitor:
        check_parameters(poll_seconds=args.poll)
        sources = [monitor.table_feed(f"{args.root}/incidents", read_latest(spark, f"{args.root}/incidents").schema)]
        if args.watch_dir:
            sources.append(monitor.watch_feed(args.watch_dir))
        for feed in sources:
            feed.seconds = args.poll
        scorer = monitor.model_scorer(spark, load_model(spark, f"{args.root}/model"), f"{args.root}/index")
        for running in monitor.run(spark, sources, scorer, f"{args.root}/monitor"):
            running.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
