import random
from collections import Counter
from math import comb

import pytest

from faultline.llm import rules, textstats


def plain_repeats(words, window=8):
    seen = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    hit = set()
    for i in range(len(words) - window + 1):
        if seen[tuple(words[i : i + window])] > 1:
            hit.update(range(i, i + window))
    return len(hit)


def test_words_in_repeats():
    rng = random.Random(1)
    for _ in range(500):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 50))]
        assert textstats.words_in_repeats(words) == plain_repeats(words)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 40, 0.2), (10, 10, 0.5), (7, 500, 0.01)])
def test_binomial_tail(k, n, p):
    assert rules.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_pick_takes_no_cutoff_that_is_not_certified():
    good, bad = [900, 90, 10, 0, 0], [0, 0, 0, 50, 50]
    assert rules.pick(good, bad, risk=0.01, error=0.01) == 2
    assert rules.pick([10, 0, 0], [0, 5, 5], risk=0.01, error=0.01) is None  # too few to tell
    assert rules.pick([500, 500], [0, 100], risk=0.01, error=0.01) is None  # would lose half
    assert rules.pick([1000, 0], [100, 0], risk=0.01, error=0.01) is None  # nothing to gain
    assert rules.pick([], [], 0.01, 0.01) is None


def test_certified_cutoffs_keep_their_promise():
    rng = random.Random(4)
    broken = 0
    for _ in range(300):
        good = [0] * 21
        for _ in range(600):
            good[min(20, int(rng.expovariate(0.5)))] += 1
        cutoff = rules.pick(good, good[::-1], risk=0.05, error=0.1)
        true_loss = 2.718281828 ** (-0.5 * (cutoff + 1)) if cutoff is not None else 0
        broken += true_loss > 0.05
    assert broken <= 0.1 * 300


def test_plain_version_on_the_given_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in rules.verdicts(docs, labels).collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    stats = {i: rules.document_statistics(r["text"]) for i, r in rows.items()}
    failed = {i: s[0] < 20 or 100 * s[4] > 30 * s[0] for i, s in stats.items()}
    strata = {rows[i]["lang"] for i in marks if not failed[i]}
    limits = {}
    for lang in strata:
        for number, rule in enumerate(rules.RULES):
            good, bad = [0] * 201, [0] * 201
            for i, q in marks.items():
                if rows[i]["lang"] == lang and not failed[i]:
                    (good if q else bad)[stats[i][5 + number]] += 1
            limits[lang, number] = rules.pick(good, bad, 0.01, 0.05 / (4 * len(strata)))
    assert any(limit is not None for limit in limits.values())
    for i, r in got.items():
        assert [r[c] for c in rules.COUNTS] == stats[i][:5] and r["base_failed"] == failed[i]
        over = any(
            limits[rows[i]["lang"], n] is not None and stats[i][5 + n] > limits[rows[i]["lang"], n] for n in range(4)
        )
        assert r["kept"] == (not failed[i] and not over)
    lost = [i for i, q in marks.items() if q == 1 and not failed[i] and not got[i]["kept"]]
    assert len(lost) <= 0.04 * sum(marks.values())


def test_odd_rows(spark, odd_documents, labels):
    got = rules.verdicts(odd_documents, labels).collect()
    assert len(got) == 11
    for r in got:
        assert r["kept"] == (not r["base_failed"])  # too few labels for any cutoff
    kept = rules.kept_documents(odd_documents, labels)
    assert kept.columns == odd_documents.columns and kept.schema == odd_documents.schema
    assert kept.count() == sum(r["kept"] for r in got)
    assert rules.verdicts(odd_documents, labels.limit(0)).count() == 11
    assert rules.verdicts(odd_documents.limit(0), labels).collect() == []


def test_repeats_of_a_labelled_row_count_once(spark):
    """One good document repeated many times certifies nothing; as many different ones do."""
    text = " ".join(f"word{i}" for i in range(40))
    shout = [" ".join(["LOUD"] * 8 + [f"w{i}x{n}" for n in range(40)]) for i in range(30)]
    cutoffs = []
    for copies, ids in ((5000, 1), (1, 5000)):
        rows = [(i, text + " extra" * (i % 7), "en") for i in range(ids) for _ in range(copies)]
        rows += [(100_000 + i, t, "en") for i, t in enumerate(shout)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        marks = spark.createDataFrame([(i, int(i < 100_000)) for i in {r[0] for r in rows}], "doc_id long, quality int")
        limit = rules.cutoffs(rules.statistics(docs), marks).first()
        cutoffs.append([limit[f"{rule}_cutoff"] for rule in rules.RULES])
    assert cutoffs[0] == [None] * 4
    assert any(c is not None for c in cutoffs[1])
