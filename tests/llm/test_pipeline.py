import pytest
from compare import compare, duck

import __spark_entry__ as entry
import corpus_pipeline
from faultline.llm import packing, pii, queries, rules, simhash


@pytest.fixture(scope="module")
def con():
    return duck("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, sf, name):
    _, rows, _, verdict = compare(spark, con, name, queries.QUERIES[name], queries.SQL.get(name), sf)
    assert rows > 0 and verdict == ("ok" if name in queries.SQL else "rows only")


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [int(name[2:].split("_")[0]) for name in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(
        range(1, 14)
    )


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    limits = {
        r["doc_id"]: r["kept"] for r in rules.verdicts(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    }
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "pack_sequences":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    kept, single, masked, mixed, packed = (frame.collect() for frame in out)
    assert {r["doc_id"] for r in kept} == {i for i, k in limits.items() if k}
    groups = {r["doc_id"]: r["component_id"] for r in simhash.classes(out[0]).collect()}
    assert sorted(r["doc_id"] for r in single) == sorted(set(groups.values()))
    for r in masked:
        text = pii.masked(rows[r["doc_id"]]["text"])
        assert (r["text"], r["n_chars"], r["source"]) == (text, len(text), rows[r["doc_id"]]["source"])
    assert len(masked) == len(single)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in masked}
    tokens = {}
    for r in packed:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    encode = packing.encoder(*packing.tokenizer_files())
    want = {}
    for r in mixed:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + len(encode(r["text"])) + 1
    assert tokens == want


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_odd_rows_pass_through_all_stages(spark, sf, odd_documents):
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert name == "pack_sequences" or docs.columns == odd_documents.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    empty = odd_documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.collect() == []


def test_stages_but_the_rules_on_odd_rows(spark, sf, odd_documents):
    docs = odd_documents
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    ids = [r["doc_id"] for r in docs.collect()]
    assert docs.columns == odd_documents.columns and set(ids) <= {1, 5, 6, 7, None} and 5 in ids
    assert all(r["_kept_id"] == 9 and r["_id"] == 5 for r in docs.collect())
