import random

import pytest

from faultline.llm import packing, tokencounts


@pytest.fixture(scope="module")
def counter():
    return tokencounts.Counter(packing.tokenizer_files())


def test_every_edit_gives_the_count_of_the_whole_text(counter):
    encode = packing.encoder(*packing.tokenizer_files())
    rng = random.Random(3)
    parts = ["a", "'", "s", "re", " ", "  ", "\n", "1", "é", ".", "'ll", "\t", "b c"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        tree = tokencounts.TokenTree(text, counter)
        assert tree.total == len(encode(text))
        for _ in range(4):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + 6))
            new = "".join(rng.choice(parts) for _ in range(rng.randint(0, 3)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.chars[1] == len(text)
            assert tree.total == len(encode(text)), (text, a, b, new)


def test_only_the_region_is_encoded(counter):
    tree = tokencounts.TokenTree("some words and more of them " * 5000, counter)
    tree.edit(70_000, 70_003, "else")
    assert tree.encoded < 60


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    encode = packing.encoder(*packing.tokenizer_files())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    edited = 0
    for r in tokencounts.counted(docs).collect():
        text = texts[r["doc_id"]]
        after = text
        for a, b, new in reversed(tokencounts.clean_up(text)):
            after = after[:a] + new + after[b:]
        assert (r["tokens_before"], r["tokens_after"]) == (len(encode(text)), len(encode(after)))
        assert r["chars_after"] == len(after)
        edited += r["n_edits"] > 0
    assert edited


def test_odd_rows(spark, odd_documents):
    got = tokencounts.counted(odd_documents).collect()
    assert len(got) == 11
    assert all(r["tokens_before"] == r["tokens_after"] == 0 for r in got if r["doc_id"] in (2, 3))
    assert tokencounts.counted(odd_documents.limit(0)).collect() == []
