import hashlib
import random
import re
import time

import pytest

from faultline.llm import pii


def plain(text):
    """The rules as they read, one pattern each."""
    found = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    four = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    found["ip"] = [m.span() for m in four if all(int(p) <= 255 for p in m.group().split("."))]
    found["card"], found["phone"] = [], []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        double = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(double) % 10 == 0:
            found["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found["phone"].append(m.span())
    return found


def test_plain_spans_of_random_texts():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@.1 0-+25()@..é") for _ in range(rng.randint(0, 40)))
        assert pii.plain_spans(text) == plain(text)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.scan(docs).collect():
        base = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
        line = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert r["spans"] == line and r["n_added"] == 0  # nothing is disguised there, nothing is made up


HIDDEN = [
    ("email", "write to ", "john.doe (at) example (dot) com", " now"),
    ("email", "write to ", "jane[at]mail[dot]org", "."),
    ("email", "", "me at site dot org", ""),
    ("email", "mail: ", "me_at_site_dot_org", " "),
    ("email", "x ", "jоhn@exаmple.com", " y"),
    ("email", "x ", "j​ane@mail.org", " y"),
    ("email", "x ", "ann＠mail．org", " y"),
    ("ip", "from ", "192[.]168[.]1[.]10", " on"),
    ("ip", "from ", "10 dot 0 dot 0 dot 7", " on"),
    ("ip", "from ", "one nine two dot one six eight dot zero dot one", " on"),
    ("card", "card ", "４１１１ 1111 1111 1111", " ok"),
    ("card", "card ", "4111–1111–1111–1111", " ok"),
    ("card", "card ", "four" + " one" * 15, " ok"),
    ("card", "card ", "4l11 1111 1111 1111", " ok"),
    ("phone", "call ", "plus one five five five two three four five six seven eight", " now"),
    ("phone", "call ", "+1 (five five five) 123-4567", " now"),
    ("phone", "call ", "＋1 555 123 4567", " now"),
]


@pytest.mark.parametrize(("kind", "before", "hidden", "after"), HIDDEN)
def test_disguises_map_back_to_the_source(kind, before, hidden, after):
    padding = "é" * 7 + " "
    text = padding + before + hidden + after
    start = len(padding + before)
    assert (start, start + len(hidden)) in pii.find(text)[1][kind]
    assert pii.masked(text) == padding + before + f"<{kind.upper()}>" + after


@pytest.mark.parametrize(
    "text",
    ["look at example.com", "one two three and four", "meet at ten dot", "a dot b", "version 1.2.3", "plus un deux", "5 l of oil"],
)
def test_clean_texts_are_left_alone(text):
    assert not any(pii.find(text)[1].values())
    assert pii.masked(text) == text


def test_plain_spans_stay():
    text = "jо" + "e@mail.org"  # a look-alike letter before a plain address
    base, every = pii.find("x jоe@mail.org")
    assert base["email"] == [(4, 14)] and every["email"] == [(2, 14), (4, 14)], text


@pytest.mark.parametrize("part", ["a", "1", "1.", "@", "+1 ", "one ", "a.", " ", "(", "a@", "l1", "[at]", " dot "])
def test_long_texts_take_linear_time(part):
    start = time.process_time()
    pii.find(part * (400_000 // len(part)))
    assert time.process_time() - start < 15


def test_odd_rows(spark, odd_documents):
    got = pii.scan(odd_documents).collect()
    assert len(got) == 11 and sum(r["n_email"] for r in got) == 1
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in got if not r["n_email"])
    masked = pii.mask(odd_documents)
    assert masked.schema == odd_documents.schema
    assert [r["text"] for r in masked.collect() if r["text"] and "<EMAIL>" in r["text"]] == [
        "a row without an id but with a mail <EMAIL>"
    ]
    assert pii.scan(odd_documents.limit(0)).collect() == []


def test_plus_before_digits():
    for text, phone in (("call plus 49 170 1234567 now", (5, 24)), ("ring Plus 1 555 123 4567", (5, 24))):
        assert pii.find(text)[1]["phone"] == [phone]
        assert pii.masked(text) == text[: phone[0]] + "<PHONE>" + text[phone[1] :]


def test_the_cheap_look_changes_no_result(monkeypatch):
    rng = random.Random(11)
    parts = ["plus ", "Plus", "+", "one ", "deux-", "ſix ", "zwei", "at", " at ", "_at_", "[at]", "@", " @ ", "dot", " punkt ", "_dot_"]
    parts += ["[.]", ".", "jane", "mail", "org ", "4111 ", "1", "49 170 ", "555 123 ", "l", "O", "é", "٣", "о", " ", "-", "SİX ", "_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    short = [pii.find(t) for t in texts]
    seen = sum(map(pii.disguised, texts))
    monkeypatch.setattr(pii, "disguised", lambda text: True)
    for text, found in zip(texts, short, strict=True):
        assert pii.find(text) == found, text
    assert 0 < seen < len(texts)


def test_offsets_of_a_very_long_disguised_text():
    filler = "а word of filler, number one, then "  # the first letter is Cyrillic
    text = filler * 40_000 + "call plus four nine one seven zero one two three four five six seven now"
    base, every = pii.find(text)
    assert base["phone"] == []
    (start, end) = every["phone"][-1]
    assert text[start:end].startswith("plus four nine") and text[start:end].endswith("seven")
