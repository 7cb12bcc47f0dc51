import itertools
import re

import pytest

from faultline.llm import filteraudit


def brute(rows, labels):
    """{(part, order, step): counts} by applying the filters of every order one after the other."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    docs = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": copy,
        }
        docs.append((lang or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, name in enumerate(order, 1):
                now = [d for d in left if name in d[1]]
                again = sum(name in d[1] for d in gone)
                alone = sum(d[1] == {name} for d in left + gone)
                left = [d for d in left if name not in d[1]]
                gone += now
                shapley[part, name] = shapley.get((part, name), 0) + len(now)
                out[part, order, step] = [len(left), len(now), again, alone, sum(d[2] for d in now), sum(d[3] for d in now)]
    for (part, order, step), counts in out.items():
        counts.append(shapley[part, order[step - 1]])
    return {key: tuple(counts) for key, counts in out.items()}


def found(frame):
    rows = frame.collect()
    out = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_filters_applied_in_turn(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    want = brute(rows, [tuple(r) for r in labels.collect()])
    assert found(filteraudit.interactions(docs, labels)) == want


def test_odd_rows(spark, odd_documents, labels):
    many = odd_documents.unionByName(odd_documents.limit(3))
    rows = [tuple(r) for r in many.select("doc_id", "text", "lang").collect()]
    got = found(filteraudit.interactions(many, labels))
    assert got == brute(rows, [tuple(r) for r in labels.collect()])
    assert "" in {part for part, _, _ in got}
    assert filteraudit.interactions(many.limit(0), labels).collect() == []
    assert found(filteraudit.interactions(many, labels.limit(0))) == brute(rows, [])


def test_copies_of_one_text(spark, labels):
    rows = [(i if i % 5 else None, "one text " * 60, "en" if i % 3 else "de") for i in range(300)]
    rows += [(1, "one text " * 60, "en")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    assert found(filteraudit.interactions(docs, labels)) == brute(rows, [tuple(r) for r in labels.collect()])


def test_fields_hold_any_count():
    huge = (1 << 62) + 12345
    for mask in (0, 5, 31):
        total = huge * filteraudit.packed(mask, "ABCDE", "removed") + 3 * filteraudit.packed(31, "ABCDE", "removed")
        fields = filteraudit.unpacked(total, "ABCDE")
        for (order, step), value in zip(filteraudit.steps("ABCDE"), fields.tolist(), strict=True):
            failed = [name for i, name in enumerate("ABCDE") if mask >> i & 1]
            hit = bool(failed) and order[step - 1] == min(failed, key=order.index)
            assert value == huge * hit + 3 * (step == 1)


@pytest.mark.parametrize("letters", ["A", "AB", "ABCD"])
def test_fewer_filters(spark, letters):
    counts = [("p", mask, 1, 0, 0) for mask in range(1 << len(letters))]
    frame = spark.createDataFrame(counts, "part string, mask int, n long, n_good long, n_toxic long")
    rows = filteraudit.audit(frame, letters).collect()
    assert len(rows) == len(letters) * len(list(itertools.permutations(letters)))
    for r in rows:
        assert r["kept"] == 2 ** (len(letters) - r["step"]) and r["removed"] == r["kept"]
