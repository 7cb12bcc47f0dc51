import zlib
from collections import Counter, defaultdict

from faultline.llm import sharding


def check(rows, texts, shards=16):
    places = defaultdict(list)
    sizes = Counter()
    for r in rows:
        places[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert (r["size"], r["text_crc32"]) in texts[r["doc_id"]]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    for found in places.values():
        assert sorted(found) == list(range(len(found)))
    return sizes


def digests(rows):
    out = defaultdict(list)
    for doc_id, text in rows:
        raw = (text or "").encode()
        out[doc_id].append((len(raw) + 1, zlib.crc32(raw)))
    return out


def test_given_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sharding.assign(docs, str(tmp_path / "map")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    sizes = check(got, digests(rows))
    assert max(sizes.values()) <= 1.01 * sum(sizes.values()) / 16


def test_map_is_edited_and_versioned(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = str(tmp_path / "map")
    first = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, path).collect()}
    again = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, path).collect()}
    assert first == again and len(list((tmp_path / "map").iterdir())) == 1
    grown = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, path, shards=17).collect()}
    assert len(list((tmp_path / "map").iterdir())) == 2
    moved = [i for i in first if grown[i] != first[i]]
    assert 16 in grown.values() and len(moved) < len(first) / 4


def test_first_map_for_fewer_shards_is_edited(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sharding.assign(docs, str(tmp_path / "map"), grown_from=15).collect()
    sizes = check(got, digests(rows))
    assert len(sizes) == 16 and max(sizes.values()) <= 1.01 * sum(sizes.values()) / 16
    first, second = (
        {r["virtual_slot"]: r["shard"] for r in spark.read.parquet(str(tmp_path / "map" / f"version={v}")).collect()}
        for v in (1, 2)
    )
    assert set(first.values()) == set(range(15)) and set(second.values()) == set(range(16))
    moved = [s for s in first if first[s] != second[s]]
    assert len(moved) < len(first) / 8
    assert {(r["virtual_slot"], r["shard"]) for r in got} <= set(second.items())


def test_edits_move_little():
    sizes = {s: 10 + s % 7 for s in range(4096)}
    before = sharding.balanced_map(sizes, 4096, 16)
    after = sharding.edited_map(before, sizes, 17)
    moved = [s for s in range(4096) if before[s] != after[s]]
    assert all(after[s] == 16 for s in moved) and len(moved) < 4096 / 15
    fewer = sharding.edited_map(before, sizes, 15)
    assert max(fewer) == 14 and all(fewer[s] == before[s] for s in range(4096) if before[s] < 15)


def test_repeated_row_is_spread(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the same")] * 5000 + [(i, "other") for i in range(2, 200)], "doc_id long, text string")
    got = sharding.assign(docs, str(tmp_path / "map")).collect()
    sizes = check(got, digests([(1, "the same"), *((i, "other") for i in range(2, 200))]))
    assert len(got) == 5198 and max(sizes.values()) <= 1.05 * sum(sizes.values()) / 16


def test_odd_rows(spark, odd_documents, tmp_path):
    got = sharding.assign(odd_documents, str(tmp_path / "a")).collect()
    check(got, digests([(r["doc_id"], r["text"]) for r in odd_documents.collect()]))
    assert len(got) == 11
    assert sharding.assign(odd_documents.limit(0), str(tmp_path / "b")).collect() == []
