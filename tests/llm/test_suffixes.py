import random

import numpy as np
import pyarrow as pa
import pytest
from brute import substring_dedup

from faultline.llm import suffixes


def check(spark, rows, most=suffixes.MOST_IN_BUCKET, most_in_batch=suffixes.MOST_IN_BATCH):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = substring_dedup(rows)
    got = suffixes.dedup(docs, most, most_in_batch).collect()
    expected = sorted((r[0] is None, r[0] or 0, *want[r]) for r in rows)
    found = sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got
    )
    assert found == expected
    return got


def invented(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 60))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        text = "\n".join(parts)
        rows.append((i, text))
        if rng.random() < 0.2:  # a near copy
            cut = rng.randint(0, len(text))
            rows.append((1000 + i, text[:cut] + "#" + text[cut + 1 :]))
    return rows


@pytest.mark.parametrize("most, most_in_batch", [(suffixes.MOST_IN_BUCKET, 64), (1, 64), (2000, 1), (2000, 3)])
def test_same_as_brute_force(spark, most, most_in_batch):
    check(spark, invented(1), most, most_in_batch)


def test_passage_in_different_surroundings(spark):
    """A passage hot in some batches and rare in others, in texts with and without an id, some repeated."""
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120))
    other = [lambda: "".join(rng.choice("ijklmnop ") for _ in range(rng.randint(20, 200)))] * 2
    rows = [(i, other[0]() + (passage if i % 3 or i < 900 else "") + other[1]()) for i in range(3000)]
    rows += [(5, rows[5][1])] * 50
    want = substring_dedup(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    got = suffixes.dedup(docs).collect()
    found = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert found == sorted((r[0], *want[r]) for r in rows)
    assert sum(r["n_removed"] > 0 for r in got) > 2000


def test_hot_strings_leave_a_task_once():
    texts = [f"{i:05d}" + "hot passage " * 9 + f"{i:05d}" for i in range(500)]
    asked = [[{"gram": 1, "lo": 0, "end": len(t)}] for t in texts]
    columns = [list(range(500)), list(range(500)), texts, asked]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["did", "dig", "text", "asked"])
    pieces = [row for out in suffixes._split_pieces(iter([batch])) for row in out.to_pylist()]
    strings = [row["piece"] for row in pieces if row["piece"] is not None]
    assert len(strings) == len(set(strings))
    assert all(row["did"] == 0 for row in pieces if row["piece"] == texts[0][5:105].encode())


def test_texts_without_an_id_are_told_apart(spark):
    rng = random.Random(13)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = [f"{i}" * 30 + chr(40 + i) + shared for i in range(40)]
    got = suffixes.dedup(spark.createDataFrame([(None, t) for t in texts] * 2, "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0] + [300] * 78


def test_no_table_is_left_behind(spark):
    suffixes.dedup(spark.createDataFrame([(1, "a" * 300)], "doc_id long, text string")).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("substring_")]


def test_periodic_long_empty_null_and_repeated(spark):
    rows = [(1, "a" * 500), (2, "ab" * 300), (3, "a" * 99), (4, "a" * 100), (5, ""), (6, None), (None, "ab" * 200)]
    rows += [(7, "x" * 40 + "ab" * 60), (8, "é" * 120), (9, "é" * 50), (9, "é" * 50), (1, "a" * 500)]
    check(spark, rows)


def test_document_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 10)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    texts = [text, "z" + text[100:4000] + "q", text[2500:]]
    raw = [t.encode() for t in texts]
    rec = suffixes.records(raw, np.arange(3), np.arange(3))
    for d in range(3):
        own = np.sort(rec[rec["did"] == d], order="lo")
        starts = [s for r in own for s in range(r["lo"], r["lo"] + r["more"] + 1)]
        assert starts == list(range(len(raw[d]) - 99))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, ranges int, did string")
    assert suffixes.dedup(docs).collect() == []


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = check(spark, rows)
    assert sum(r["n_removed"] for r in got) > 0


def test_depth_buckets():
    rng = random.Random(5)
    raw = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)), dtype=np.uint8)
    for depth in (8, 20, 100):
        starts = np.arange(len(raw) - depth + 1)
        number = suffixes.buckets_at_depth(raw, starts, depth)
        strings = [raw[s : s + depth].tobytes() for s in starts]
        assert len(set(zip(number.tolist(), strings, strict=True))) == len(set(strings)) == len(set(number.tolist()))
