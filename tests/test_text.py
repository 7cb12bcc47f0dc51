import pytest
from pyspark.sql import functions as F

from faultline.functions import text
from faultline.operators import features


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("o")).first()["o"]


def core(spark, value):
    return one(spark, value, text.normalise)


def test_core_tokens_follow_the_word_rules(spark):
    assert core(spark, "The pilot's engines, and/or wings: 3,000 feet!") == "pilot engine wing foot"
    assert core(spark, "Take-off delayed; crew didn't respond.") == "delayed crew respond"
    assert core(spark, "AT&T (radio) failed...twice at 5,6 and x,y") == "radio failed twice x"
    assert core(spark, "cannot climb") == "climb"


def test_only_real_contractions_are_taken_apart(spark):
    both = lambda value: (core(spark, value), one(spark, value, lambda c: text.normalise(c, "api", lemmas=False)))
    assert both("lemna canna wanta gotme") == ("lemna canna wanta gotme", "lemna canna wanta gotme")
    assert both("gonna land, gotta climb, lemme see")[0] == core(spark, "gon na land got ta climb lem me see")


def test_core_keeps_accented_words_and_numbers(spark):
    assert core(spark, "Störung im Netz 42") == "störung im netz 42"


def test_core_of_long_unbroken_text_is_linear(spark):
    assert core(spark, "x" * 200_000 + "-" + "y" * 200_000) == ""


def test_api_profile(spark):
    assert one(spark, "B-737 engines at FL350, ok?", lambda c: text.normalise(c, "api")) == "engine"
    assert one(spark, None, lambda c: text.normalise(c, "api")) == ""


def test_lemmas(spark):
    words = {
        "engines": "engine", "flies": "fly", "boxes": "box", "crashes": "crash", "passes": "pass",
        "women": "woman", "bus": "bus", "glass": "glass", "analysis": "analysis", "children": "child",
        "news": "news", "gas": "gas", "runway": "runway", "ties": "tie",
    }
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["l"] for r in rows.select("w", F.expr(text.lemma_sql("w")).alias("l")).collect()}
    assert got == words


def test_snippet_and_strip(spark):
    assert one(spark, "abcdef", lambda c: text.snippet(c, 3)) == "abc..."
    assert one(spark, "abc", lambda c: text.snippet(c, 3)) == "abc"
    assert one(spark, "\t a b\r\n", text.strip) == "a b"


def test_report_lines(spark):
    good = "The relay misoperated and tripped the second circuit of the line"
    lines = [
        good.replace(" ", "   "),
        "short line",
        "1" * 50,
        "THIS IS A BANNER THAT IS WRITTEN IN CAPITAL LETTERS ONLY AND IS LONG ENOUGH",
        "Figure 3 shows the frequency of the eastern interconnection",
        "See page 12 for the list of all protection system operations",
    ]
    assert one(spark, "\r\n".join(lines), text.clean_lines) == [good]


def test_sentences_are_grouped_by_five(spark):
    sentences = [f"This is sentence number {i} of the report." for i in range(12)]
    kept = one(spark, [" ".join(sentences) + " Too short."][0], lambda c: text.sentences(F.array(c)))
    assert kept == sentences
    frame = spark.createDataFrame([(sentences,), ([],)], "s array<string>")
    groups = [r["g"] for r in frame.select(text.sentence_groups(F.col("s")).alias("g")).collect()]
    assert [len(g) for g in groups] == [3, 0]
    assert groups[0][2] == " ".join(sentences[10:])


def test_bigrams(spark):
    frame = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r["t"] for r in frame.select(text.with_bigrams(F.col("w")).alias("t")).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_redaction(spark):
    # "C:/" goes first, so a path right after it keeps no leading slash to be replaced.
    assert one(spark, r"C:\Users\me\x /home/me /tmp/a", text.redact_paths) == "Users/me/x [home]/me [tmp]/a"
    assert one(spark, r"in /Users/me and \var\log", text.redact_paths) == "in [user]/me and [var]/log"
    assert one(spark, r"at D:\work\a.py", text.redact_paths_for_display) == "at [system-path]"
    assert one(spark, "see /home/me/file now", text.redact_paths_for_display) == "see [home-path]"
    assert one(spark, r"\srv/secret/", text.redact_paths_for_display) == "[system-path]"
    assert one(spark, r"in \srv/secret/, then", text.redact_paths_for_display) == "in [system-path], then"
    assert one(spark, r"in \srv\a/b/shown.txt", text.redact_paths_for_display) == "in shown.txt"
    assert one(spark, r"only \srv\name", text.redact_paths_for_display) == r"only \srv\name"


def test_ids(spark):
    assert one(spark, "Power Grid - São/2", text.safe_file_id) == "Power_Grid_-_São_2"
    assert len(one(spark, "x", text.content_key)) == 16


@pytest.mark.parametrize(("table_bytes", "most"), [(8 << 20, 8), (40, 8), (40, 0)])
def test_lemmas_of_a_table(spark, monkeypatch, table_bytes, most):
    monkeypatch.setattr(features, "TABLE_BYTES", table_bytes)
    monkeypatch.setattr(features, "MOST_TABLES", most)
    lemma = {f"word{i}s": f"word{i}" for i in range(30)} | {"same": "same", "unused": "x"}
    # a lemma that is itself an entry is not looked up again
    lemma |= {"word1": "word2s"}
    lemmas = spark.createDataFrame([*lemma.items(), ("word3s", "zzz"), ("none", None)], "word string, lemma string")
    texts = ["word0s word1s same word1", "", None, "other none word3s word29s", "word5s word5s", "word5s word5s"]
    rows = [(i % 5, t) for i, t in enumerate(texts)]
    words = spark.createDataFrame(rows, "id long, words string")
    got = features.lemmatise_by_table(words, lemmas, "id")
    want = [(i, None if t is None else " ".join(lemma.get(w, w) for w in t.split(" "))) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    if most:
        # no shuffle, and no row carries a table
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert "AS _table" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert features.lemmatise_by_table(words, lemmas.limit(0), "id").count() == len(rows)
    assert features.lemmatise_by_table(words.limit(0), lemmas, "id").count() == 0
