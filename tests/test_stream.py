import csv
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from faultline.operators import features, retrieval
from faultline.session import subfolders
from faultline.sources import alerts as log
from faultline.sources import dropfiles, feeds
from faultline.streaming import ledger, monitor

DEMO = (
    "id,narrative\n"
    "DEMO-001,Engine fire at FL350, declared emergency.\n"
    "DEMO-002,Unplanned power cut affecting 250 customers.\n"
    "DEMO-003,Routine preflight checks.\n"
)


@pytest.fixture
def folders(tmp_path):
    drop, root = tmp_path / "drop", tmp_path / "root"
    drop.mkdir()
    return drop, str(root)


def scan(spark, drop, root):
    return monitor.scan_once(spark, [monitor.watch_feed(str(drop))], monitor.unlabelled_scorer, root)


def test_documented_scan(spark, folders):
    drop, root = folders
    (drop / "DEMO.csv").write_text(DEMO)
    assert scan(spark, drop, root) == 3
    alerts = {r["incident_id"]: r for r in monitor.read_alerts(spark, root).collect()}
    assert {k: r["risk_level"] for k, r in alerts.items()} == {"DEMO-001": "critical", "DEMO-002": "critical"}
    assert alerts["DEMO-001"]["narrative"] == "Engine fire at FL350 declared emergency."
    assert alerts["DEMO-001"]["source"] == "watch/DEMO.csv"
    assert scan(spark, drop, root) == 0
    assert monitor.read_alerts(spark, root).count() == 2
    parsed = log.parse_alert_log(monitor.read_alerts(spark, root))
    assert parsed.filter("alert_ts is not null and size(evidence) = 0").count() == 2


def test_more_files_and_duplicates(spark, folders):
    drop, root = folders
    (drop / "DEMO.csv").write_text(DEMO)
    (drop / "README.txt").write_text("crash")
    (drop / "notes.md").write_text("crash")
    scan(spark, drop, root)
    (drop / "a.csv").write_text(
        "ID,Other,Text,x\r\nDEMO-001,o,crash again,\r\n\r\n,o,nan,\r\nN-1,o,\"Smoke, heavy\" ,tail \"q\"\r\n"
        " ,o,terrain warning,\r\nN-1,o,second of the id,\r\n"
    )
    (drop / "B.TXT").write_text("\n Lost contact with the tower \n")
    (drop / "empty.txt").write_text("  \n")
    (drop / "blank.csv").write_text("\nx,y\n")
    (drop / "plain.csv").write_text("whatever\nmayday, mayday\n")
    assert scan(spark, drop, root) == 4
    alerts = {r["incident_id"]: r["narrative"] for r in monitor.read_alerts(spark, root).collect()}
    assert alerts["N-1"] == 'Smoke, heavy tail "q"'
    assert alerts["a-row5"] == "terrain warning"
    assert alerts["B.TXT"] == "Lost contact with the tower"
    assert alerts["plain-row1"] == "mayday mayday"
    assert len(alerts) == 6


def test_line_breaks_inside_quotes(spark, tmp_path):
    """The csv module writes and reads the same files; blocks of two kilobytes cut records anywhere."""
    folder = tmp_path / "breaks"
    folder.mkdir()
    rng, want = random.Random(4), {}
    parts = ["fire", 'a "quoted" word', "x, y", "line\nbreak", "two\n\nbreaks", "calm", '5" pipe']
    for f in range(2):
        rows = [(f"f{f}r{i}", " ".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))) for i in range(120)]
        with open(folder / f"f{f}.csv", "w", newline="") as out:
            quoting = csv.QUOTE_ALL if f else csv.QUOTE_MINIMAL
            csv.writer(out, lineterminator="\n", quoting=quoting).writerows([("id", "narrative"), *rows])
        want |= dict(rows)
    (folder / "odd.csv").write_text('id,narrative\nA,"calm first line\nfire on the second"\n\nB,5" pipe burst\n,"no id\nhere"\n')
    want |= {"A": "calm first line\nfire on the second", "B": '5" pipe burst', "odd-row4": "no id\nhere"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        rows = dropfiles.csv_incidents(dropfiles.read_lines(spark, str(folder)))
        assert {r["incident_id"]: r["narrative"] for r in rows.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_numbers_over_many_blocks(spark, tmp_path):
    folder = tmp_path / "big"
    folder.mkdir()
    lines = ["narrative"] + [f"line {i} of the file" for i in range(1, 20001)]
    (folder / "big.csv").write_text("\n".join(lines) + "\n")
    (folder / "small.csv").write_text("report\nonly row\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20000)
    try:
        rows = dropfiles.csv_incidents(dropfiles.read_lines(spark, str(folder)))
        found = {r["incident_id"]: r["narrative"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 20001
    assert all(found[f"big-row{i}"] == f"line {i} of the file" for i in range(1, 20001))
    assert found["small-row1"] == "only row"


def test_fields(spark):
    cases = {
        "a,b": ["a", "b"],
        ",b,": ["", "b", ""],
        '"x, ""y""",z': ['x, "y"', "z"],
        'a"b, c ': ['a"b', "c"],
        '"ab"cd,e': ["abcd", "e"],
        "": [""],
    }
    frame = spark.createDataFrame([(k,) for k in cases], "l string")
    got = {r["l"]: r["f"] for r in frame.select("l", dropfiles.csv_fields(F.col("l")).alias("f")).collect()}
    assert got == cases


def test_batch_run_again_changes_nothing(spark, folders):
    drop, root = folders
    layout = "key string, incident_id string, source string, narrative string, risk_floor string"
    feed = monitor.Feed("f", lambda s: None, lambda batch: batch)
    rows = [("a", "a", "s", "explosion", None), ("a", "a", "s", "calm", None), (None, None, "s", "smoke", None), ("b", "b", "s", "calm", "high")]
    batch = spark.createDataFrame(rows, layout)
    monitor.handle_batch(batch, 0, feed, monitor.unlabelled_scorer, root)
    first = {(r["incident_id"], r["risk_level"], r["narrative"]) for r in monitor.read_alerts(spark, root).collect()}
    assert first == {("b", "high", "calm"), ("manual", "critical", "smoke")}
    assert monitor.read_seen(spark, root).count() == 3
    monitor.handle_batch(batch, 0, feed, monitor.unlabelled_scorer, root)
    again = {(r["incident_id"], r["risk_level"], r["narrative"]) for r in monitor.read_alerts(spark, root).collect()}
    assert again == first and monitor.read_seen(spark, root).count() == 3
    monitor.handle_batch(batch, 1, feed, monitor.unlabelled_scorer, root)
    assert monitor.read_alerts(spark, root).count() == 2


def test_feeds(spark, tmp_path):
    path = tmp_path / "faults"
    path.mkdir()
    records = [
        {"incidentreference": "R1", "powercuttype": "Unplanned", "mainmessage": " Fault. ", "operatingzone": "North", "postcodesaffected": "AB1.", "nocustomeraffected": 120},
        {"record": {"fields": {"incidentreference": "R2", "powercuttype": "UNPLANNED", "incidentcategorycustomerfriendlydescription": "Cable"}}},
        {"fields": {"incidentreference": "R3", "powercuttype": "unplanned", "nocustomeraffected": "5"}},
        {"incidentreference": "R4", "powercuttype": "Planned"},
        {"powercuttype": "Unplanned"},
    ]
    (path / "a.json").write_text("\n".join(map(json.dumps, records)) + "\nnot json\n")
    rows = {r["key"]: r for r in feeds.fault_incidents(feeds.read_feed(spark, str(path), "fault")).collect()}
    assert rows["ukpn-R1"]["narrative"] == "Fault. Affecting the North operating zone. postcodes AB1. 120 customers affected."
    assert rows["ukpn-R1"]["risk_floor"] == "high" and rows["ukpn-R3"]["risk_floor"] is None
    assert rows["ukpn-R2"]["narrative"] == "Cable."
    assert rows["ukpn-R3"]["narrative"] == "Unplanned power cut. 5 customers affected."
    assert len(rows) == 3
    assert feeds.fault_rejects(feeds.read_feed(spark, str(path), "fault")).count() == 3

    acc = tmp_path / "acc"
    acc.mkdir()
    records = [
        {"ev_id": "1", "ev_date": "2024-01-02", "acft_make": "CESSNA", "acft_model": "172", "ev_city": "Reno", "ev_state": "NV", "ev_country": "", "ev_highest_injury": "NONE", "probable_cause": " Fuel exhaustion "},
        {"ev_id": "2", "probable_cause": "Icing"},
        {"ev_id": "3", "probable_cause": " "},
        {"probable_cause": "No id"},
    ]
    (acc / "a.json").write_text("\n".join(map(json.dumps, records)))
    rows = {r["key"]: r["narrative"] for r in feeds.accident_incidents(feeds.read_feed(spark, str(acc), "accident")).collect()}
    assert rows == {
        "ntsb-1": "On 2024-01-02 a CESSNA 172 at Reno, NV (NONE injury outcome): Fuel exhaustion",
        "ntsb-2": "Icing",
    }
    root = str(tmp_path / "root")
    sources = [monitor.fault_feed(str(path)), monitor.accident_feed(str(acc))]
    assert monitor.scan_once(spark, sources, monitor.unlabelled_scorer, root) == 5
    assert monitor.scan_once(spark, sources, monitor.unlabelled_scorer, root) == 0


def test_appended_rows_after_a_baseline(spark, tmp_path):
    path, root = str(tmp_path / "t"), str(tmp_path / "root")
    rows = spark.createDataFrame([(1, "explosion", "x", "Aviation")], "incident_id long, narrative string, label string, domain string")
    rows.write.parquet(path)
    feed = monitor.table_feed(path, rows.schema)
    assert monitor.scan_once(spark, [feed], monitor.unlabelled_scorer, root) == 0
    rows.withColumn("incident_id", F.lit(2).cast("long")).unionByName(rows).write.mode("append").parquet(path)
    assert monitor.scan_once(spark, [feed], monitor.unlabelled_scorer, root) == 1
    assert [r["incident_id"] for r in monitor.read_alerts(spark, root).collect()] == ["ds-row-2"]


def test_evidence_goes_into_the_log(spark, folders):
    drop, root = folders
    rows = [(i, f"pump leaked fuel near valve {100 + i}", "Fuel" if i % 2 else "Pump", "Aviation") for i in range(20)]
    corpus = spark.createDataFrame(rows, "incident_id long, narrative string, label string, domain string")
    model = features.fit_tfidf(features.add_processed(corpus))
    retrieval.save_index(retrieval.build_index(corpus, model), f"{root}/index")

    def score(new):
        found = retrieval.explain(new, retrieval.load_index(spark, f"{root}/index"), model, id_col="key")
        return found.withColumn("predicted_label", F.get("evidence", F.lit(0))["label"])

    (drop / "x.csv").write_text("id,narrative\nA,valve 107 leaked fuel\n")
    assert monitor.scan_once(spark, [monitor.watch_feed(str(drop))], score, root) == 1
    alert = log.parse_alert_log(monitor.read_alerts(spark, root)).first()
    assert alert["risk_level"] == "critical" and alert["predicted_label"] == "Fuel"
    assert [e["rank"] for e in alert["evidence"]] == [1, 2, 3]


def test_stream_state_dedupe_within_a_bound(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:02:00")]
    frame = spark.createDataFrame(rows, "key string, t string").withColumn("t", F.col("t").cast("timestamp"))
    frame.write.parquet(path)
    stream = spark.readStream.schema(frame.schema).parquet(path)
    (
        monitor.drop_seen(stream, "key", "t", "1 hour").writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        .start(str(tmp_path / "out")).awaitTermination()
    )
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_scratch_is_removed(spark, tmp_path):
    from faultline.session import materialise, path_exists, scratch

    with scratch(spark) as folder:
        assert materialise(spark.range(3), "x").count() == 3
        assert path_exists(spark, folder)
    assert not path_exists(spark, folder)


def test_fault_record_is_read_from_one_container(spark):
    layout = "mainmessage string, nocustomeraffected string, fields struct<incidentreference:string, powercuttype:string, mainmessage:string, nocustomeraffected:string>"
    rows = [("outer", "500", ("R1", "Unplanned", None, None))]
    flat = feeds.flatten_faults(spark.createDataFrame(rows, layout)).first()
    assert (flat["incidentreference"], flat["mainmessage"], flat["nocustomeraffected"]) == ("R1", None, 0)


def test_changed_files_are_read_again(spark, folders):
    drop, root = folders
    feed = monitor.watch_feed(str(drop), changed_files=True)
    scan_all = lambda: monitor.scan_once(spark, [feed], monitor.unlabelled_scorer, root)
    (drop / "README.csv").write_text("id,narrative\nX,explosion\n")
    (drop / ".hidden.csv").write_text("id,narrative\nY,explosion\n")
    (drop / "a.csv").write_text(DEMO)
    assert scan_all() == 3 and scan_all() == 0
    (drop / "a.csv").write_text(DEMO + "NEW-1,smoke in the cabin\nNEW-2,calm\n")
    (drop / "b.txt").write_text("mayday, mayday")
    assert scan_all() == 3 and scan_all() == 0
    (drop / "b.txt").write_text("another explosion")  # the same report by its name
    assert scan_all() == 0
    alerts = {r["incident_id"] for r in monitor.read_alerts(spark, root).collect()}
    assert {"NEW-1", "b.txt", "DEMO-001", "DEMO-002"} == alerts


def test_blocks_of_a_watched_file(spark, tmp_path):
    from faultline.sources import watchfolder

    folder, root = tmp_path / "big", str(tmp_path / "root")
    folder.mkdir()
    lines = ["narrative"] + [f"line {i} of the file, smoke" for i in range(1, 3001)]
    (folder / "big.csv").write_text("\n".join(lines))
    feed = monitor.Feed("big", lambda s: watchfolder.watched_stream(s, f"file:{folder}", 5000), dropfiles.mixed_incidents)
    assert monitor.scan_once(spark, [feed], monitor.unlabelled_scorer, root) == 3000
    alerts = {r["incident_id"]: r["narrative"] for r in monitor.read_alerts(spark, root).collect()}
    assert alerts == {f"big-row{i}": f"line {i} of the file smoke" for i in range(1, 3001)}


def test_two_feeds_with_one_key_alert_once(spark, folders):
    import threading

    drop, root = folders
    layout = "key string, incident_id string, source string, narrative string, risk_floor string"
    batch = spark.createDataFrame([(f"k{i}", f"k{i}", "s", "explosion", None) for i in range(50)], layout)
    found = []

    def handle(name):
        feed = monitor.Feed(name, lambda s: None, lambda b: b)
        found.append(monitor.handle_batch(batch, 0, feed, monitor.unlabelled_scorer, root))

    threads = [threading.Thread(target=handle, args=(f"f{i}",)) for i in range(3)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(found) == [0, 0, 50]
    assert monitor.read_alerts(spark, root).count() == 50


def test_ledger_opens_its_slots_and_is_merged(spark, folders):
    _, root = folders
    for n in range(9):
        rows = spark.createDataFrame([(f"k{n}-{i}",) for i in range(40)] + [("again",)], "key string")
        assert ledger.claim(rows, root, "f", n).count() == 41 - (n > 0)
        ledger.compact(spark, root, merge_after=3)
    assert len(subfolders(spark, f"{root}/claims/feed=f", "batch=")) <= 3
    assert len(subfolders(spark, f"{root}/ledger", "segment=")) < 3
    rows = spark.createDataFrame([(f"k{n}-{i}",) for n in range(9) for i in range(40)], "key string")
    assert ledger.claim(rows, root, "g", 0).count() == 0
    # run again, the newest batch finds its own keys new
    assert ledger.claim(spark.createDataFrame([("k8-1",), ("k7-1",)], "key string"), root, "f", 8).count() == 1
    plan = ledger.known_keys(spark, root, [3, 5], "f", 9)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*slot#\d+ IN", plan)) == 2


def test_table_of_part_files_streams(spark, tmp_path):
    """A table may be one file or a folder of part files; the stream gives all rows of either."""
    from faultline.catalog.q_stream import stream_duplicates

    texts = [(i, f"text {i % 7}" if i % 5 else None, "en", "s1", 6) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars int")
    docs.repartition(3).write.parquet(f"{tmp_path}/parts/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/landed")
    (tmp_path / "one").mkdir()
    part = next((tmp_path / "landed").glob("part-*.parquet"))
    part.rename(tmp_path / "one" / "documents.parquet")
    for sf_dir in (f"{tmp_path}/parts", f"{tmp_path}/one"):
        keys = [r["key"] for r in stream_duplicates(spark, sf_dir).collect()]
        assert len(keys) == 8 and len(set(keys)) == 8


def test_records_over_batches_and_runs(spark, tmp_path):
    """Records and runs go on over Arrow batches of a few lines; only records cut by a run's end are shuffled."""
    folder = tmp_path / "small-batches"
    folder.mkdir()
    rng, want = random.Random(5), {}
    parts = ["fire", 'a "quoted" word', "x, y", "line\nbreak", "two\n\nbreaks", "calm"] + ["\n".join(f"l{i}" for i in range(30))]
    for f in range(3):
        rows = [(f"f{f}r{i}", " ".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))) for i in range(80)]
        with open(folder / f"f{f}.csv", "w", newline="") as out:
            csv.writer(out, lineterminator="\n").writerows([("id", "narrative"), *rows])
        want |= dict(rows)
    (folder / "open.csv").write_text('id,narrative\nA,"never closed\nfire')
    want |= {"A": '"never closed\nfire'}
    for block, batch in ((700, 3), (1 << 20, 7)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            lines = dropfiles.read_lines(spark, str(folder))
            assert {r["incident_id"]: r["narrative"] for r in dropfiles.csv_incidents(lines).collect()} == want
            plan = dropfiles.whole_records(lines)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_first_of_a_key_leaves_texts_where_they_lie(spark):
    layout = "key string, arrival string, narrative string"
    rows = [("a", "2", "late"), ("a", "1", "z"), ("a", "1", "early"), ("b", "1", "one"), ("", "1", "t"), (None, "0", "t")]
    rows += [(None, "3", None), (None, "2", None)]
    first = monitor.first_of_each_key(spark.createDataFrame(rows, layout))
    found = sorted((r["key"] or "", r["narrative"]) for r in first.collect())
    assert found == [("", None), ("8efd86fb78a56a51", "t"), ("a", "early"), ("b", "one")]
    assert "Exchange hashpartitioning" not in first._jdf.queryExecution().executedPlan().toString()


def test_watched_files_come_in_batches(tmp_path):
    import pyarrow as pa

    from faultline.sources import watchfolder

    ends = ["\n", "\r\n", "\r"]
    text = "".join(f"line {i} é{ends[i % 3]}" for i in range(500)) + "last"
    (tmp_path / "a.csv").write_bytes(text.encode())
    size = len(text.encode())
    reader = watchfolder.FolderReader({"path": str(tmp_path), "blockBytes": "97"})
    found = []
    for block in reader.partitions({}, {str(tmp_path / "a.csv"): [size, 0]}):
        for batch in reader.read(block):
            assert isinstance(batch, pa.RecordBatch)
            found += batch.column("line").to_pylist()
    assert found == [f"line {i} é" for i in range(500)] + ["last"]
