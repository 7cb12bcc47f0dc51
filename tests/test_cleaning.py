import random

import pytest
from pyspark.sql import functions as F

from faultline import schema
from faultline.operators import audit, cleaning, requests
from faultline.sources import dropfiles
from faultline.sources import incidents as src

ROWS = "incident_id long, narrative string, label string"


def test_bucketing_is_idempotent(spark):
    labels = ["a"] * 5 + ["b"] * 4 + ["c"] * 2 + ["d"] * 2 + ["Other"] * 20 + [None]
    frame = spark.createDataFrame([(i, l) for i, l in enumerate(labels)], "i long, label string")
    once = cleaning.bucket_rare_labels(frame, 3)
    counts = {r["label"]: r["count"] for r in once.groupBy("label").count().collect()}
    assert counts == {"a": 5, "b": 4, "c": 2, "Other": 22, None: 1}
    again = cleaning.bucket_rare_labels(once, 3)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_merge_keeps_the_first_copy(spark):
    long = "this narrative is long enough to stay"
    aviation = spark.createDataFrame(
        [(5, long, "A; B"), (3, long, "C"), (9, "short", "A"), (7, "x" * 21, None), (8, "y" * 20, "A")], ROWS
    )
    power = spark.createDataFrame([(1, long, "Grid"), (2, long + "!", "Grid")], ROWS)
    got = {(r["incident_id"], r["label"], r["domain"]) for r in cleaning.merge_domains(aviation, power).collect()}
    assert got == {(3, "C", schema.AVIATION), (2, "Grid", schema.POWER)}
    with pytest.raises(RuntimeError):
        cleaning.merge_domains(None, None)


def test_one_text_in_a_third_of_all_rows(spark):
    frame = spark.range(30_000).select(
        F.col("id").alias("incident_id"),
        F.when(F.col("id") % 3 == 0, "the same text again and again").otherwise(F.concat(F.lit("text "), "id")).alias("narrative"),
    )
    kept = cleaning.first_of_each_text(frame, ["incident_id"])
    assert kept.count() == 20_001
    assert kept.filter("narrative like 'the same%'").first()["incident_id"] == 0
    assert cleaning.keep_first(frame, "narrative", ["incident_id"]).count() == 20_001


def test_join_sides_too_big_to_broadcast_give_the_same_rows(spark):
    from faultline.operators import split

    frame = spark.range(5000).select(
        F.col("id").alias("incident_id"),
        F.when(F.col("id") % 3 == 0, "copy").otherwise((F.col("id") % 1700).cast("string")).alias("narrative"),
        (F.col("id") % 5).cast("string").alias("label"),
    )

    def rows():
        kept = {r["incident_id"] for r in cleaning.first_of_each_text(frame, ["incident_id"]).collect()}
        test = {r["incident_id"] for r in split.train_test(frame).filter("split = 'test'").collect()}
        return kept, test

    small = rows()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert rows() == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(small[1]) == 1000


def test_repeated_texts_do_not_shuffle_the_table(spark, tmp_path):
    spark.range(1000).selectExpr("id as incident_id", "cast(id % 900 as string) as narrative").write.parquet(str(tmp_path / "t"))
    kept = cleaning.first_of_each_text(spark.read.parquet(str(tmp_path / "t")), ["incident_id"])
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_first_of_each_text_whatever_the_list_weighs(spark, threshold):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", f"text {rng.randint(0, 400)}", f"alone {i}"])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "incident_id long, narrative string")
    wanted = {}
    for i, text in rows:
        wanted.setdefault((text is None, text), i)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        kept = sorted(r["incident_id"] for r in cleaning.first_of_each_text(frame, ["incident_id"]).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert kept == sorted(wanted.values())


def test_only_possible_copies_are_shuffled(spark, tmp_path):
    rows = [(i, f"text {i if i % 10 else 0}") for i in range(20_000)]
    spark.createDataFrame(rows, "incident_id long, narrative string").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    listed = frame.select(F.sha2("narrative", 256).alias("_digest")).groupBy("_digest").count().filter("count > 1")
    bitmap = cleaning.mark_bitmap(listed.select("_digest"))
    flagged = cleaning.with_mark(frame.withColumn("_digest", F.sha2("narrative", 256)), bitmap)
    assert {r["_marked"] for r in flagged.filter("incident_id % 10 = 0").select("_marked").collect()} == {True}
    assert flagged.filter("_marked and incident_id % 10 <> 0").count() <= 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = cleaning.first_of_each_text(frame, ["incident_id"])
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # every exchange that carries the narrative takes rows of the bitmap's join only
    shuffled = [at for at, line in enumerate(plan.split("\n")) if "Exchange hashpartitioning(_digest" in line]
    below = [plan.split("\n")[at + 1 : at + 5] for at in shuffled]
    carrying = [part for part in below if any("narrative" in line for line in part[:2])]
    assert carrying and all(any("BroadcastHashJoin" in line for line in part) for part in carrying)
    assert kept.count() == 18_001


def test_fallback_is_per_domain(spark):
    layout = ROWS + ", domain string"
    cached = spark.createDataFrame([(1, "old a", "A", "Aviation"), (2, "old p", "P", "Power Grid")], layout)
    fresh = spark.createDataFrame([(3, "new a", "A", "Aviation")], layout)
    assert sorted(r["incident_id"] for r in src.with_fallback(fresh, cached).collect()) == [2, 3]
    assert src.with_fallback(None, cached).count() == 2
    assert src.with_fallback(fresh, None).count() == 1
    with pytest.raises(RuntimeError):
        src.with_fallback(None, None)
    layout = "incident_id long, narrative string, label string, domain string"
    one, two = (spark.createDataFrame([(i, "n", "l", None)], layout) for i in (1, 2))
    assert [r["incident_id"] for r in src.with_fallback(one, two).collect()] == [1]


def test_null_texts_are_one_text(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "b")], "incident_id long, narrative string")
    kept = cleaning.first_of_each_text(rows, ["incident_id"]).collect()
    assert sorted(r["incident_id"] for r in kept) == [1, 3, 5]


def test_every_source_row_is_taken(spark):
    from faultline.catalog import QUERIES, load_all, views

    sf = "/root/testdata/sf0.1"
    load_all()
    want = views.incidents(spark, sf).filter("domain = 'Aviation' and trim(narrative) <> '' and trim(label_raw) <> ''")
    assert QUERIES["src2_source_rows"](spark, sf).count() == want.count() > 2000


def test_refresh_builds_once_and_may_read_what_it_replaces(spark, tmp_path):
    path, calls = str(tmp_path / "table"), []

    def build(cached):
        calls.append(cached is not None)
        first = spark.createDataFrame([(1, "n", "l", "Aviation")], ROWS + ", domain string")
        return first if cached is None else cached.unionByName(first)

    assert src.refresh(spark, path, build).count() == 1
    assert src.refresh(spark, path, build).count() == 1
    assert src.refresh(spark, path, build, force=True).count() == 2
    assert calls == [False, True]


def test_csv_with_old_column_names(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_text('Narrative,human_factors_groundtruth,Domain,extra\n"a, ""b""\nc",L,Aviation,1\n')
    row = src.load_incidents(spark, str(path), "csv").collect()
    assert [tuple(r) for r in row] == [('a, "b"\nc', "L", "Aviation")]
    only = tmp_path / "two.csv"
    only.write_text("narrative,label\nx,y\n")
    assert tuple(src.load_incidents(spark, str(only), "csv").first()) == ("x", "y", None)
    with pytest.raises(FileNotFoundError):
        src.load_incidents(spark, str(tmp_path / "none"))


def test_csv_split_over_tasks_reads_as_sparks_own_reader(spark, tmp_path):
    rows = [("id", "text, more")] + [
        (str(i), ["plain", "two\nlines", 'a "quoted, word"', " padded ", "", None, "cr\r\nlf", "open \" quote"][i % 8])
        for i in range(400)
    ]
    frame = spark.createDataFrame(rows, "id string, `the text` string")
    frame.repartition(3).write.options(**dropfiles.CSV_WRITER).csv(str(tmp_path / "c"))
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path / "c"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 512)
    try:
        got = dropfiles.read_csv(spark, str(tmp_path / "c"))
        assert got.columns == ["id", "the text"]
        want = [(i, t or None) for i, t in rows]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # Spark's reader gives the same, a file in one task.
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(want, key=str)


def test_csv_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffid,,id\r\n1,x,y\r\n\r\n2\r\n")
    got = dropfiles.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "_c1", "_c2"]
    assert sorted(map(tuple, got.collect())) == [("1", "x", "y"), ("2", None, None)]
    (tmp_path / "empty.csv").write_text("")
    assert dropfiles.read_csv(spark, str(tmp_path / "empty.csv")).collect() == []
    assert src.load_incidents(spark, str(tmp_path / "empty.csv"), "csv").columns == ["narrative", "label", "domain"]


def test_source_rows_need_both_fields_and_keep_order(spark):
    rows = spark.createDataFrame(
        [(3, " c ", "l"), (1, "a", "l"), (2, "  ", "l"), (4, "d", None), (5, "e", "l")],
        "row_idx long, `Report 1_Narrative` string, Events_Anomaly string",
    )
    assert [r["narrative"] for r in src.source_rows(rows, "row_idx", cap=2).collect()] == ["a", "c"]
    assert src.source_rows(rows, "row_idx", cap=None).count() == 3


def test_audit_counts(spark):
    rows = [(0, "a" * 30, "A"), (1, "a" * 30, "A"), (2, "tiny", "B"), (3, None, None), (4, "b" * 40, "Other")]
    frame = spark.createDataFrame(rows, ROWS).withColumn("domain", F.lit("Aviation"))
    got = audit.quality_audit(frame).first().asDict()
    assert (got["rows"], got["missing_labels"], got["missing_narratives"]) == (5, 1, 1)
    assert (got["duplicate_narratives"], got["short_narratives"], got["classes"]) == (1, 1, 3)
    assert (got["majority_class"], got["minority_class"], got["imbalance"]) == ("A", "Other", 2.0)
    assert got["other_share"] == 0.2 and got["vocabulary"] == 3
    status = {r["metric"]: r["status"] for r in audit.graded_audit(frame).collect()}
    assert status["Missing labels"] == "WARN" and status["Class imbalance (majority/minority ratio)"] == "OK"


def test_requests(spark):
    frame = spark.createDataFrame([("x" * 10, 3), ("x" * 9, 3), (None, 1), ("x" * 10001, 1), ("x" * 50, 11)], "narrative string, top_k int")
    accepted, rejected = requests.split_requests(requests.check_classify_requests(frame))
    assert accepted.count() == 1
    assert sorted(r["reason"] for r in rejected.collect()) == [
        "narrative missing", "narrative too long", "narrative too short", "top_k out of range",
    ]
    requests.check_parameters(cv_folds=3, test_size=0.2)
    with pytest.raises(ValueError):
        requests.check_parameters(cv_folds=11)


def test_fallback_does_not_gather_a_domain_in_one_task(spark):
    from faultline.sources.incidents import with_fallback

    layout = "incident_id bigint, narrative string, label string, domain string"
    fresh = spark.range(20000).selectExpr("id as incident_id", "sha2(cast(id as string), 256) as narrative", "'l' as label", "'A' as domain")
    cached = spark.createDataFrame([(1, "a", "l", "A"), (2, "b", "l", "B"), (3, "c", "l", None)], layout)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 4000)
    try:
        rows = with_fallback(fresh, cached)
        plan = rows._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r["incident_id"] for r in rows.filter("domain is null or domain <> 'A'").collect()) == [2, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
