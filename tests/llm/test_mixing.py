import pytest
from pyspark.sql import functions as F

from faultline.llm import mixing


def level(sizes, weights, most=3):
    """Targets by repeated resharing."""
    stopped, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(stopped.values())
        open_ = {s: w for s, w in weights.items() if s not in stopped}
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > most * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped.update({s: float(most * sizes[s]) for s in over})


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 300, "d": 0, "é": 5, None: 40}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = dict(zip(names, [1.0, 2.0, 3.0] * 2, strict=True))
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame).collect()}
    assert got == pytest.approx(level(sizes, weights))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_takes_come_near_their_targets(spark):
    rows = [(i, "word " * (i % 37), f"s{i % 4 if i % 3 else 0}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.draw(docs, bands=64).collect()
    assert len(got) == 3000
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 37
        assert all(r["taken"] in (r["size"] * mine[0]["times"], r["taken"]) for r in mine)
        assert {r["times"] for r in mine if r["size"]} <= {int(mine[0]["target"] // mine[0]["source_size"]) + i for i in (0, 1)}
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    again = mixing.draw(docs.repartition(7), bands=64).collect()
    assert sorted(tuple(r) for r in again) == sorted(tuple(r) for r in got)


def test_bands_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one, many = (sorted(tuple(r) for r in mixing.draw(docs, bands=b).collect()) for b in (1, 5000))
    assert one == many


def test_heavier_documents_are_drawn_more_often(spark):
    rows = [(i, ("good text " if i % 2 else "b# *# ") * 10, "a") for i in range(4000)] + [(-1, "x " * 80_000, "b")]
    got = mixing.draw(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    share = [sum(r["times"] for r in got if r["source"] == "a" and r["doc_id"] % 2 == odd) / 2000 for odd in (0, 1)]
    assert 0.1 < share[0] < share[1] * 0.6


def test_odd_rows(spark, odd_documents):
    got = mixing.draw(odd_documents).collect()
    assert len(got) == 11
    assert sum(r["taken"] for r in got) == pytest.approx(sum(r["size"] for r in got), rel=1)
    mixed = mixing.mix_rows(odd_documents)
    assert mixed.columns == odd_documents.columns
    times = sum(r["times"] for r in got if r["times"] > 0)
    assert mixed.count() == times
    empty = odd_documents.limit(0)
    assert mixing.draw(empty).collect() == [] and mixing.mix_rows(empty).collect() == []


def test_nothing_but_empty_texts(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.draw(docs).collect()] == [(0.0, 0), (0.0, 0)]


def test_takes_stay_with_their_source(spark):
    text = "one text of six words only"
    rows = [(1, text, "b", "x"), (1, text, "a", "y")] + [(i, text + f" {i}", "b", "x") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _times string")
    want = {}
    for r in mixing.draw(docs).collect():
        if r["times"]:
            want[r["doc_id"], r["source"]] = r["times"]
    got = {}
    for r in mixing.mix_rows(docs).collect():
        assert r["_times"] == ("y" if r["source"] == "a" else "x")
        got[r["doc_id"], r["source"]] = got.get((r["doc_id"], r["source"]), 0) + 1
    assert got == want


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, "a text without an id", "a")] * 3000 + [(None, f"text {i} without an id", "a") for i in range(2000)]
    rows += [(i, "some longer text for the other source of the mix " * 3, "b") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.draw(docs, weights=(1.0, 4.0)).collect()
    for source in ("a", "b"):
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 30
    again = mixing.draw(docs.repartition(3), weights=(1.0, 4.0)).collect()
    key = lambda rows: sorted((r["doc_id"] or -1, r["size"], r["source"], r["taken"]) for r in rows)
    assert key(again) == key(got)


def test_another_weight(spark):
    rows = [(i, ("new " if i % 2 else "old ") * 10, "a") for i in range(3000)] + [(-1, "x " * 60_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.draw(docs, weights=(1.0, 4.0), weight=lambda text: F.when(text.contains("new"), 4.0).otherwise(1.0)).collect()
    new, old = (sum(r["times"] for r in got if r["source"] == "a" and r["doc_id"] % 2 == odd) for odd in (1, 0))
    assert new > 1.5 * old > 0
