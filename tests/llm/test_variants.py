import random
import re
import zlib

import numpy as np
import pytest

from faultline.llm import variants


def near(a, b):
    """One insertion, deletion or replacement, by trying them all."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def counts_of(rows, every):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(counts):
    """{word: (n, n_near, form, form_n, root)} from all pairs that share a form with one letter out."""
    bins = {}
    for w in counts:
        for form in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            bins.setdefault(form, set()).add(w)
    around = {w: set() for w in counts}
    for words in bins.values():
        for a in words:
            around[a] |= {b for b in words if b != a and near(a, b)}
    forms = {}
    for w, others in around.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return {w: (n, len(around[w]), forms[w], forms[w] and counts[forms[w]], root(w)) for w, n in counts.items()}


def found(frame):
    rows = frame.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def random_words(n, letters, seed=3, least=5, most=9):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(letters, k=rng.randint(least, most))) for _ in range(n)})


@pytest.mark.parametrize("letters", ["ab", "etg", "abcdé", "aeiouäöü×"])
@pytest.mark.parametrize("large", [variants.LARGE_LEAF, 2])
def test_trie_finds_each_near_pair_once(letters, large, monkeypatch):
    monkeypatch.setattr(variants, "LARGE_LEAF", large)
    monkeypatch.setattr(variants, "ALIVE", 700)
    words = random_words(600, letters)
    raw = [w.encode("latin-1") for w in words]
    trie = variants.Trie(raw)
    got = [
        frozenset((words[a], trie.letters.words[b].decode("latin-1")))
        for q, at in trie.near_words(raw)
        for a, b in zip(q.tolist(), at.tolist(), strict=True)
    ]
    want = {frozenset((a, b)) for a in words for b in words if a != b and near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_every_reachable_slice_is_visited():
    words = [w.encode("latin-1") for w in random_words(400, "abcdefgh")]
    vectors = variants.count_vectors(words)
    keys = variants.path_keys(vectors)
    cuts = np.unique(np.sort(keys)[::40])
    row, to = variants.reachable(vectors, cuts)
    visited = set(zip(row.tolist(), to.tolist(), strict=True))
    own = np.searchsorted(cuts, keys, side="right")
    for a in range(len(words)):
        for b in range(len(words)):
            if a != b and near(words[a], words[b]):
                assert (a, own[b]) in visited or (b, own[a]) in visited


def test_long_words_are_compared_whole():
    base = "ab" * 400
    words = [base, base[:-1], base + "c", base[:600] + "c" + base[601:], base[:600] + "cc" + base[602:], "x" + base]
    raw = [w.encode() for w in sorted(words)]
    trie = variants.Trie(raw)
    got = {frozenset((raw[a], trie.letters.words[b])) for q, at in trie.near_words(raw) for a, b in zip(q, at, strict=True)}
    want = {frozenset((a, b)) for a in raw for b in raw if a != b and near(a.decode(), b.decode())}
    assert got == want and len(got) > 4


@pytest.mark.parametrize("slice_words", [variants.SLICE_WORDS, 60])
def test_plain_version_on_the_given_table(spark, sf, slice_words):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = found(variants.groups(docs, drop_every=97, slice_words=slice_words))
    assert got == brute(counts_of(rows, 97))
    assert any(r[2] for r in got.values())


def test_chains_and_ties(spark):
    times = {"spelling": 40, "speling": 20, "spelin": 10, "spelxn": 5, "spelyn": 5, "spzlyn": 3, "other": 50}
    text = " ".join(w for w, n in times.items() for _ in range(n))
    docs = spark.createDataFrame([(1, text), (2, "abcd abcd abcd few few")], "doc_id long, text string")
    got = found(variants.groups(docs))
    assert got == brute(times)
    assert got["spzlyn"][2] is None and got["spelxn"][4] == "spelling" and got["speling"][3] == 40


def test_odd_rows(spark, odd_documents):
    more = [(None, "Äpfel Äpfel äpfel ÄPFEL über×wort über×wort über×wort", "x" * 10)] * 3
    docs = odd_documents.unionByName(
        spark.createDataFrame(more, "doc_id long, text string, word string"), allowMissingColumns=True
    )
    docs = docs.withColumns({"n": docs["size"], "slice": docs["rank"]})
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for every in (None, 3):
        assert found(variants.groups(docs, drop_every=every)) == brute(counts_of(rows, every))
    assert variants.groups(docs.limit(0)).collect() == []


def test_long_text_in_pieces():
    text = "Some words, some more wordsandwords " * 500 + "z" * 5000
    want = re.findall("[A-Za-z]+", text)
    for at_once in (1, 7, 1000):
        assert [w for found in variants.runs(text, at_once) for w in found] == want
