import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import ann


def exact(ids, rows, asked, nearest):
    norms = np.sqrt((rows * rows).sum(axis=1))
    out = {}
    for q in asked:
        i = int(np.flatnonzero(ids == q)[0])
        scores = (rows * rows[i]).sum(axis=1) / (norms * norms[i])
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:nearest]
        out[q] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_exact_scores_on_the_given_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = found(ann.search(vectors, F.col("vec_id") % 50 == 0, rows_in_cell=700, queries_in_cell=16))
    table = vectors.toPandas()
    ids, rows = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    want = exact(ids, rows, [i for i in ids.tolist() if i % 50 == 0], 5)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    scores = {(q, i): s for q, pairs in exact(ids, rows, list(want), len(ids)).items() for i, s in pairs}
    for q, pairs in got.items():
        assert len(pairs) == 5
        assert [s for _, s in pairs] == sorted((s for _, s in pairs), reverse=True)
        assert all(s == pytest.approx(scores[q, i], abs=1e-15) for i, s in pairs)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]),
        (7, [inf, 1.0]), (8, []), (9, [-1.0, 0.0]), (None, [1.0, 0.0]), (1, [2.0, 0.0]), (10, [1.0, 1.0, 1.0]),
        (20, [0.0, 0.0]),
    ]
    docs = spark.createDataFrame([(*r, 1.0, 1) for r in rows], "vec_id long, embedding array<double>, score double, rank int")
    got = found(ann.search(docs, F.col("vec_id") % 10 == 0))
    # ties go to the smaller id; of other lengths, zero, null or broken nothing is found
    assert got == {0: [(1, 1.0), (2, 1.0), (9, -1.0)]}


def test_many_copies_are_ranked_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(i, [1.0, float(i), -2.0]) for i in range(200, 260)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(ann.search(docs, F.col("vec_id") == 50, rows_in_cell=64))
    assert [i for i, _ in got[50]] == [0, 1, 2, 3, 4]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.search(docs, F.col("vec_id") % 50 == 0).collect() == []


def test_very_large_and_very_small_components(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e200]), (2, [3e-300, 4e-300]), (3, [-1e-200, 1e-320]), (50, [1e308, -1e308])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.search(docs, F.col("vec_id") % 50 == 0))
    half = 0.5**0.5
    assert sorted(i for i, _ in got[0]) == [1, 2, 3, 50] and len(got[50]) == 4
    assert dict(got[0]) == pytest.approx({1: half, 50: half, 2: 0.6, 3: -1.0})


@pytest.mark.parametrize("rows_in_cell", [ann.ROWS_IN_CELL, 40])
def test_ids_with_several_vectors(spark, rows_in_cell):
    rows = [(0, [1.0, 0.0])] + [(1, [float(i), 100.0 - i]) for i in range(100)]
    rows += [(i, [1.0, float(i)]) for i in range(2, 9)] + [(0, [0.0, 1.0])] * 2
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.search(docs, F.col("vec_id") == 0, rows_in_cell=rows_in_cell))
    # the query has two vectors; each id counts with its best one for either
    best = {1: 1.0, **{i: i / (1 + i * i) ** 0.5 for i in range(2, 9)}}
    assert [i for i, _ in got[0]] == [1, 8, 7, 6, 5]
    assert [s for _, s in got[0]] == pytest.approx([best[i] for i in (1, 8, 7, 6, 5)], abs=1e-12)
