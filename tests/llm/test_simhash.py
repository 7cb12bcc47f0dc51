import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from faultline.llm import simhash


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    """rows: (doc_id, fingerprint); the least id reachable, for each row."""
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label, strict=True):
        if doc is not None:
            least[x] = min(least.get(x, doc), doc)
    return [least.get(x) for x in label]


def near(rng, fp, bits):
    return fp ^ sum(1 << b for b in rng.sample(range(64), bits))


def families(seed, n):
    """Fingerprints with chains of small steps, so that components are wider than the radius."""
    rng = random.Random(seed)
    fps = []
    while len(fps) < n:
        fp = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            fps.append(fp)
            fp = near(rng, fp, rng.choice([0, 1, 3, 4, 4, 5, 6]))
    return fps[:n]


def test_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(docs).collect()}
    assert got == {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    for text in ("ÄB C", "a", "A B C D", "  x\ty\n", None, ""):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_bit_sliced_comparison_is_exact():
    fps = np.array(families(1, 300), dtype=np.uint64)
    for radius in (0, 2, 4, 6):
        want = {
            (i, j) for i in range(300) for j in range(i + 1, 300) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius
        }
        runs = {p for a, b in simhash.links_in_runs(fps, np.array([300]), radius) for p in zip(a.tolist(), b.tolist(), strict=True)}
        chunk = {(i, j) for i, found in simhash.links_between(fps, fps, radius) for j in found.tolist() if j > i}
        assert runs == want and chunk == want


def test_any_link_shares_two_blocks():
    rng = random.Random(2)
    masks = [((1 << bits) - 1) << at for at, bits in simhash.BLOCKS]
    assert sum(masks) == (1 << 64) - 1
    for _ in range(2000):
        change = near(rng, 0, rng.randint(0, 4))
        assert sum(not change & m for m in masks) >= 2


@pytest.mark.parametrize("most", [simhash.MOST_IN_BUCKET, 3])
def test_components(spark, monkeypatch, most):
    # few leading bits in use: full buckets, split into chunks at the small limit
    fps = families(3, 250) + [f & 0xFFFFF for f in families(4, 120)]
    nodes = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(fps)], "fp long, doc_id long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.selectExpr("doc_id", "fp", "fp as digest"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(nodes, most).collect()}
    assert [got[i] for i in range(len(fps))] == plain_components(list(enumerate(fps)))


def test_hot_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(5)
    fps = [near(rng, 0xABCDEF0123456789, rng.randint(0, 3)) for _ in range(3000)]
    rows = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(fps)], "fp long, doc_id long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.selectExpr("doc_id", "fp", "fp as digest"))
    assert {r["component_id"] for r in simhash.classes(rows, 500).collect()} == {0}
    edges = simhash.links(rows.select("fp").distinct(), 500).count()
    assert edges < 40 * len(set(fps))


def test_hub_is_split_over_tasks(spark, tmp_path):
    star = spark.range(40_000).selectExpr("if(id % 2 = 0, 0L, id) as u", "id + 1 as v").repartition(8)
    star.write.parquet(str(tmp_path / "edges"))
    edges = spark.read.parquet(str(tmp_path / "edges"))
    least = simhash.materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        found = simhash.point_at(edges, least).select("v", "m").distinct()
        assert {(r["v"], r["m"]) for r in found.collect() if r["v"] % 2} == {(v, 1) for v in range(1, 40_000, 2)}
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_plain_version_on_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(docs).collect()}
    assert [got[i] for i, _ in rows] == plain_components(rows)
    assert any(i != c for i, c in got.items())
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect())
    assert kept == sorted(set(got.values()))


def test_odd_rows(spark, odd_documents):
    got = simhash.classes(odd_documents).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len(got) == 11
    assert {by_id[i][0]["component_id"] for i in (1, 6)} == {1}
    assert all(r["fp"] == 0 and r["component_id"] == 2 for i in (2, 3, 4) for r in by_id[i])
    kept = simhash.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is None, i))
    assert ids[:3] == [1, 2, 5] and 6 not in ids and ids.count(None) <= 1
    assert simhash.classes(odd_documents.limit(0)).collect() == []
    assert simhash.one_of_each(odd_documents.limit(0)).collect() == []
