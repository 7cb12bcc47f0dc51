from pyspark.sql import functions as F

from faultline import schema
from faultline.catalog import views
from faultline.operators.classifier import load_model
from faultline.plans import batch
from faultline.session import read_latest
from faultline.sources.alerts import parse_alert_log
from faultline.sources.incidents import normalise_columns
from faultline.streaming import monitor


def test_batch_job(spark, tmp_path):
    root, sf = str(tmp_path / "job"), "/root/testdata/sf0.01"
    landed = views.incidents(spark, sf).filter("domain = 'Aviation'").select(
        F.col("incident_id").alias("row_idx"),
        F.col("narrative").alias("Report 1_Narrative"),
        F.col("label_raw").alias("Events_Anomaly"),
    )
    reports = views.reports(spark, sf).filter("report_id % 20 = 0")
    tables = batch.run_batch(
        spark, root, batch.aviation_rows(landed), reports, samples=20,
        alphas=[1e-4], weightings=["balanced"], count=2, max_features=1500, max_iter=20,
    )
    totals = tables["totals"].first()
    assert totals["total_reports"] > 300 and 0 < totals["accuracy"] <= 1
    assert tables["examples"].count() == 10
    explained = spark.read.parquet(f"{root}/explained")
    assert explained.count() == 20
    trained_on = {
        r["incident_id"] for r in read_latest(spark, f"{root}/prepared").filter("split = 'train'").collect()
    }
    assert not trained_on & {r["incident_id"] for r in explained.collect()}
    record = {r["setting"]: r["value"] for r in tables["training"].collect()}
    assert record["cv_folds"] == "2" and int(record["n_train"]) > int(record["n_test"]) > 0
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.csv").write_text("id,narrative\nA,engine fire after takeoff\nB,paperwork completed today\n")
    (drop / "b.txt").write_text("smoke odor in cockpit")
    scorer = monitor.model_scorer(spark, load_model(spark, f"{root}/model"), f"{root}/index")
    feed = monitor.watch_feed(str(drop), max_files=1)
    assert monitor.scan_once(spark, [feed], scorer, f"{root}/monitor") == 3
    alerts = parse_alert_log(monitor.read_alerts(spark, f"{root}/monitor")).collect()
    assert {"A", "b.txt"} <= {r["incident_id"] for r in alerts}
    assert all(len(r["evidence"]) == 3 and r["predicted_label"] for r in alerts)
    # Unforced, the stored table is used; a domain whose source is silent keeps its stored rows.
    again = batch.build_incidents(spark, root, None, None)
    assert again.count() == totals["total_reports"]
    forced = batch.build_incidents(spark, root, batch.aviation_rows(landed, cap=50), None, force=True)
    counts = {r["domain"]: r["count"] for r in forced.groupBy("domain").count().collect()}
    assert counts[schema.AVIATION] <= 50 and counts[schema.POWER] > 0
    assert normalise_columns(forced).columns == list(schema.CANONICAL)
