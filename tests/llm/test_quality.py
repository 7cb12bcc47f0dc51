import zlib

import numpy as np

from faultline.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(p == q for p, q in held) / len(held) >= 0.95


def test_labels_of_the_holdout_change_nothing(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr(
        "doc_id", "cast(if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as int) quality"
    )
    one, two = ({r["doc_id"]: r["score"] for r in quality.classify(docs, t).collect()} for t in (labels, turned))
    assert one == two


def test_walk_is_the_same_as_a_plain_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    trees = quality.fit(x, y, trees=20)
    for row, score in zip(x[:50], trees.score(x[:50]), strict=True):
        margin = trees.base
        for t in range(20):
            node = 0
            while node < 2**trees.depth - 1:
                node = 2 * node + 1 + bool(row[trees.feature[t, node]] > trees.limit[t, node])
            margin += trees.value[t, node - (2**trees.depth - 1)]
        assert np.isclose(score, 1 / (1 + np.exp(-margin)))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9


def test_odd_rows(spark, odd_documents, labels):
    got = quality.classify(odd_documents, labels).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert all(not r["held_out"] for r in got if r["doc_id"] is None)
    same = {r["score"] for r in got if r["doc_id"] in (1, 6)}
    assert len(same) == 1  # equal texts, whatever their language and source


def test_without_labels_or_rows(spark, odd_documents, labels):
    assert {r["score"] for r in quality.classify(odd_documents, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(odd_documents.limit(0), labels).collect() == []
