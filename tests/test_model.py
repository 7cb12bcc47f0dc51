import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from faultline.catalog import q_model, views
from faultline.functions import lexicon
from faultline.operators import classifier, evaluation, features, postings, retrieval, scoring, split, termwork

WORDS = "valve pump rotor blade relay feeder breaker gauge rudder flap".split()


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(1)
    rows = [(i, " ".join(random.choices(WORDS, k=random.randint(0, 12))), f"L{i % 4}", "Aviation") for i in range(120)]
    return spark.createDataFrame(rows, "incident_id long, narrative string, label string, domain string")


def brute_terms(text):
    words = [w for w in text.split() if w not in lexicon.STOPWORDS + lexicon.VECTOR_STOPWORDS]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_vectors(docs, queries, size):
    terms = {i: brute_terms(t) for i, t in docs.items()}
    cf = Counter(t for ts in terms.values() for t in ts)
    vocab = [t for t, _ in sorted(cf.items(), key=lambda x: (-x[1], x[0]))[:size]]
    df = Counter(t for ts in terms.values() for t in set(ts))
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocab}

    def vector(ts):
        raw = {t: n * idf[t] for t, n in Counter(ts).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        return {t: v / norm for t, v in raw.items()}

    return {i: vector(ts) for i, ts in terms.items()}, {q: vector(brute_terms(t)) for q, t in queries.items()}


def test_weights_and_evidence_against_brute_force(spark, corpus, monkeypatch):
    docs = {r["incident_id"]: r["narrative"] for r in corpus.collect()}
    queries = {i: " ".join(random.Random(i).choices(WORDS + ["unknown"], k=4)) for i in range(25)} | {99: "nothing known"}
    processed = features.add_processed(corpus)
    model = features.fit_tfidf(processed, max_features=60)
    vectors, asked = brute_vectors(docs, queries, 60)

    got = {(r["incident_id"], r["term"]): r["weight"] for r in features.term_weights(processed, model).collect()}
    want = {(i, t): w for i, v in vectors.items() for t, w in v.items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)

    def best(query):
        sims = {i: round(sum(w * v.get(t, 0.0) for t, w in asked[query].items()), 9) for i, v in vectors.items()}
        return [i for i, _ in sorted(sims.items(), key=lambda x: (-x[1], x[0]))[:5]]

    index = retrieval.build_index(corpus.repartition(5), model)
    frame = spark.createDataFrame(list(queries.items()), "query_id long, narrative string")
    asked_frame = retrieval.query_vectors(frame, model)
    rows = retrieval.indexed(index).rows
    for list_documents, block, share in ((65_536, 128, 0.25), (10, 2, 0.25), (10, 2, 1.0), (40, 5, 0.0)):
        monkeypatch.setattr(postings, "OPEN_SHARE", share)
        held = retrieval.EvidenceIndex(rows, postings.build_postings(rows, list_documents, block))
        found = {}
        for r in retrieval.top_evidence(asked_frame, held, 5).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["incident_id"])
        assert found == {q: best(q) for q in queries}
    assert found[99] == [0, 1, 2, 3, 4]


def test_lists_and_blocks(spark, corpus):
    model = features.fit_tfidf(features.add_processed(corpus))
    rows = retrieval.indexed(retrieval.build_index(corpus, model)).rows
    made = postings.build_postings(rows, list_documents=10, block=4)
    terms = {r["term_no"]: r for r in made.terms.collect()}
    want = {(r["term_no"], r["incident_id"], r["weight"]) for r in postings.entries_of(rows).collect()}
    of_list = {n: t for t, r in terms.items() for n in range(r["first_list"], r["first_list"] + r["n_lists"])}
    got, tops = set(), {}
    for r in made.lists.orderBy("list_no", "block").collect():
        weights = [e["weight"] for e in r["entries"]]
        assert r["top"] == weights[0] and weights == sorted(weights, reverse=True) and len(weights) <= 4
        assert r["top"] <= tops.get(r["list_no"], 2.0)
        tops[r["list_no"]] = weights[-1]
        got |= {(of_list[r["list_no"]], e["incident_id"], e["weight"]) for e in r["entries"]}
    assert got == want and max(r["n_lists"] for r in terms.values()) > 3


def test_stored_index_is_joined_where_it_lies(spark, corpus, tmp_path):
    model = features.fit_tfidf(features.add_processed(corpus))
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        retrieval.load_index(spark, path)
    retrieval.save_index(retrieval.build_index(corpus.limit(30), model), path)
    retrieval.save_index(retrieval.build_index(corpus, model), path, buckets=8)
    held = retrieval.load_index(spark, path)
    assert held.rows.count() == corpus.count()
    asked = retrieval.query_vectors(corpus.select(F.col("incident_id").alias("query_id"), "narrative"), model)
    key = lambda frame: sorted(map(str, frame.collect()))
    assert key(retrieval.top_evidence(asked, held)) == key(retrieval.top_evidence(asked, retrieval.build_index(corpus, model)))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = spark.range(100).selectExpr("id as list_no", "id as incident_id").repartition(3)
        for side, by in ((held.postings.lists, "list_no"), (held.rows, "incident_id")):
            plan = wanted.select(by).join(side, by)._jdf.queryExecution().executedPlan().toString()
            # the one exchange by key is that of the other side
            assert plan.count("hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_evidence_shape(spark, corpus):
    model = features.fit_tfidf(features.add_processed(corpus))
    asked = spark.createDataFrame([("q", "valve pump"), ("r", "")], "incident_id string, narrative string")
    rows = retrieval.explain(asked, retrieval.build_index(corpus, model), model).collect()
    for row in rows:
        assert [e["rank"] for e in row["evidence"]] == [1, 2, 3]
        sims = [e["similarity"] for e in row["evidence"]]
        assert sims == sorted(sims, reverse=True) and all(0 <= s <= 1 + 1e-9 for s in sims)
    with pytest.raises(ValueError):
        retrieval.top_evidence(asked, asked, 11)


def test_few_documents_and_no_query(spark, corpus):
    model = features.fit_tfidf(features.add_processed(corpus))
    index = retrieval.build_index(corpus.limit(2), model)
    asked = retrieval.query_vectors(corpus.select(F.col("incident_id").alias("query_id"), "narrative"), model)
    assert retrieval.top_evidence(asked.limit(1), index).count() == 2
    assert retrieval.top_evidence(asked.filter("false"), index).count() == 0


def test_string_ids(spark, corpus):
    named = corpus.withColumn("incident_id", F.concat(F.lit("id-"), "incident_id"))
    model = features.fit_tfidf(features.add_processed(named))
    asked = retrieval.query_vectors(named.select(F.col("incident_id").alias("query_id"), "narrative"), model)
    ranked = retrieval.top_evidence(asked, retrieval.build_index(named, model), 1)
    best = {r["query_id"]: r["similarity"] for r in ranked.collect()}
    full = [r["incident_id"] for r in named.filter("narrative <> ''").collect()]
    assert all(abs(best[i] - 1) < 1e-9 for i in full)


def test_dense(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(200, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    frame = spark.createDataFrame(rows, "incident_id long, embedding array<double>")
    asked = frame.withColumnRenamed("incident_id", "query_id")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    sims = unit @ unit.T
    want = {i: sorted(range(200), key=lambda j: (-round(sims[i, j], 9), j))[:3] for i in range(200)}
    found = {}
    for r in retrieval.top_dense(asked, frame).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["incident_id"])
    assert found == want


def test_split_is_exact_for_a_hot_label(spark):
    labels = ["hot"] * 4000 + [f"l{i % 7}" for i in range(700)] + ["one"] + [None] * 5
    frame = spark.createDataFrame(list(enumerate(labels)), "incident_id long, label string")
    parts = split.train_test(frame)
    counts = {(r["label"], r["split"]): r["count"] for r in parts.groupBy("label", "split").count().collect()}
    assert counts[("hot", "test")] == 800 and counts[("hot", "train")] == 3200
    assert counts[("l3", "test")] == 20 and counts[("one", "train")] == 1
    assert parts.count() == 4701
    fold = {(r["label"], r["fold"]): r["count"] for r in split.folds(frame).groupBy("label", "fold").count().collect()}
    assert [fold[("hot", f)] for f in range(3)] == [1333, 1334, 1333]


def test_evaluation(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")]
    frame = spark.createDataFrame(pairs, "label string, predicted_label string")
    counts = evaluation.pair_counts(frame)
    assert evaluation.accuracy(counts).first()["accuracy"] == round(8 / 11, 6)
    rows = {r["class"]: r for r in evaluation.classification_report(counts).collect()}
    assert (rows["c"]["precision"], rows["c"]["recall"], rows["c"]["f1"], rows["c"]["support"]) == (0, 0, 0, 1)
    assert rows["a"]["precision"] == round(5 / 6, 6) and rows["a"]["recall"] == round(5 / 7, 6)
    assert rows["macro avg"]["support"] == 11
    matrix = {(r["true_label"], r["predicted_label"]): (r["n"], r["share"]) for r in evaluation.confusion_matrix(counts).collect()}
    assert len(matrix) == 9 and matrix[("c", "c")] == (0, 0.0) and matrix[("c", "a")] == (1, 1.0)
    f1 = {k: rows[k]["f1"] for k in "abc"}
    assert abs(evaluation.weighted_f1(counts) - (f1["a"] * 7 + f1["b"] * 3 + f1["c"]) / 11) < 1e-5


def test_classifier(spark, sf, tmp_path):
    parts = split.train_test(q_model.prepared(spark, "/root/testdata/sf0.01"))
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    trained = classifier.fit_classifier(train, 1e-4, max_iter=40, max_features=2000)
    predicted = trained.predict(test)
    accuracy = evaluation.accuracy(evaluation.pair_counts(predicted)).first()["accuracy"]
    assert accuracy > 0.71
    classifier.save_model(trained, spark, str(tmp_path / "m"))
    loaded = classifier.load_model(spark, str(tmp_path / "m"))
    assert loaded.config == trained.config

    def labels(model):
        return {r["incident_id"]: r["predicted_label"] for r in model.predict(test).collect()}

    assert labels(loaded) == labels(trained)


def test_saved_pipeline_is_all_that_predicting_needs(spark, tmp_path):
    rows = spark.createDataFrame(
        [("fire in the engine", "fire"), ("engine fire", "fire"), ("ice on wing", "ice"), (None, "ice"), ("wing ice", "ice")],
        "processed_text string, label string",
    )
    trained = classifier.fit_classifier(rows, 1e-4, None, max_features=5, max_iter=20)
    trained.stages.write().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    vectoriser = loaded.stages[0]
    assert (vectoriser.terms, vectoriser.idf, vectoriser.documents) == (
        trained.vectoriser.terms,
        trained.vectoriser.idf,
        5,
    )
    got = {r["processed_text"]: r["predicted_label"] for r in loaded.transform(rows).collect()}
    assert got["engine fire"] == "fire" and got["wing ice"] == "ice" and None in got
    other = trained.predict(rows.withColumnRenamed("processed_text", "words"), "words").collect()
    assert {r["words"]: r["predicted_label"] for r in other} == got


def test_vocabulary_of_every_fold_comes_from_its_own_rows(spark, monkeypatch):
    texts = [(i, f"{'fire' if i % 2 else 'ice'} word{i}", "hot" if i % 2 else "cold") for i in range(12)]
    rows = spark.createDataFrame([*texts, (90, "lone", "rare")], "incident_id long, processed_text string, label string")
    fitted = []
    plain = features.Tfidf._fit

    def noted(self, dataset):
        model = plain(self, dataset)
        fitted.append((model.documents, set(model.terms)))
        return model

    monkeypatch.setattr(features.Tfidf, "_fit", noted)
    found = classifier.search(rows, alphas=(1e-3, 1e-4), weightings=(None, "balanced"), count=3, max_iter=20)
    assert len(found.scores) == 4 and all(0 < s["f1_weighted"] <= 1 for s in found.scores)
    best = max(s["f1_weighted"] for s in found.scores)
    first = next(s for s in found.scores if s["f1_weighted"] == best)
    assert found.trained.config["best_params"] == {"alpha": first["alpha"], "class_weight": first["class_weight"]}
    # Four settings, yet one vocabulary per fold and one of all rows.
    assert len(fitted) == 4 and sorted(n for n, _ in fitted)[-1] == 13
    assert sum(n for n, _ in fitted) == 13 * 3
    assert all(len(terms) < len(fitted[-1][1]) for _, terms in fitted[:-1])


def test_rows_of_a_fold_become_vectors_once_for_all_settings(spark, monkeypatch):
    """Scores of four settings take one transformation per fold, and its tables are removed."""
    texts = [(i, f"{'fire' if i % 2 else 'ice'} word{i % 5}", "hot" if i % 2 else "cold") for i in range(24)]
    rows = spark.createDataFrame(texts, "incident_id long, processed_text string, label string")
    transformed, written = [], []
    plain, write = features.TfidfModel._transform, classifier.materialise

    def noted(self, dataset):
        transformed.append(dataset)
        return plain(self, dataset)

    def kept(frame, purpose):
        found = write(frame, purpose)
        written.extend(found.inputFiles() if purpose in ("fold-vectors", "fit-rows") else [])
        return found

    monkeypatch.setattr(features.TfidfModel, "_transform", noted)
    monkeypatch.setattr(classifier, "materialise", kept)
    found = classifier.search(rows, alphas=(1e-3, 1e-4), weightings=(None, "balanced"), count=3, max_iter=20)
    # Once per fold, and for the rows of the last fit.
    assert len(transformed) == 4 and written
    assert not [path for path in written if os.path.exists(path.removeprefix("file:").replace("///", "/"))]
    best = max(found.scores, key=lambda score: score["f1_weighted"])
    assert found.trained.config["best_cv_f1_weighted"] == best["f1_weighted"] == 1.0 and best["f1_deviation"] == 0.0


def test_class_weights(spark):
    frame = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "label string")
    weights = {r["label"]: r["weight"] for r in classifier.class_weights(frame).collect()}
    assert weights == {"a": 8 / 12, "b": 2.0}


def test_views_agree_on_row_counts(spark, sf):
    assert views.incidents(spark, sf).count() == 200


def test_vocabulary_counts_rare_terms_by_bucket_only(spark, monkeypatch):
    """Terms of buckets that stay below the bound are not counted by name; those kept have exact counts."""
    rng = random.Random(7)
    texts = [" ".join(f"w{min(rng.randint(1, 400), rng.randint(1, 400))}" for _ in range(60)) for _ in range(80)] + [None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "processed_text string").repartition(3)
    cf, df = Counter(), Counter()
    for words in ((t or "").split() for t in texts):
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        cf.update(terms)
        df.update(set(terms))
    want = sorted(((-n, term, df[term]) for term, n in cf.items()))[:20]
    kept = features.vocabulary(docs, 20)
    assert [(-r["cf"], r["term"], r["df"]) for r in kept.collect()] == want
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    marks = np.zeros(termwork.BUCKETS, dtype=bool)
    marks[termwork.bucket(np.array([zlib.crc32(b"w1")], np.uint64))] = True
    named = list(termwork.counts([batch], frozenset(), np.packbits(marks).tobytes()))[0].to_pydict()
    assert named == {"term": ["w1"], "cf": [cf["w1"]], "df": [df["w1"]]}


def test_frame_of_vectors_is_scored_like_an_index(spark):
    """Both ways of finding evidence give the same rows, ties and queries without a known term among them."""
    rng = random.Random(3)

    def vector(terms):
        weights = {t: rng.choice([0.5, 1.0, 2.0]) for t in terms}
        norm = sum(w * w for w in weights.values()) ** 0.5
        return sorted(weights), [weights[t] / norm for t in sorted(weights)]

    docs = [(i, *vector(rng.sample(range(30), rng.randint(0, 5))), f"l{i % 3}", "d", f"s{i}") for i in range(150)]
    layout = "incident_id bigint, indices array<int>, values array<double>, label string, domain string, snippet string"
    index = spark.createDataFrame(docs, layout)
    rows = [(i, *vector(rng.sample(range(40), rng.randint(0, 4)))) for i in range(25)] + [(99, [], [])]
    asked = spark.createDataFrame(rows, "query_id bigint, indices array<int>, values array<double>")
    by_index = retrieval.top_evidence(asked, retrieval.indexed(index))
    by_frame = retrieval.top_evidence(asked, index)
    order = lambda frame: sorted((r["query_id"], r["rank"], r["incident_id"], r["similarity"], r["snippet"]) for r in frame.collect())
    assert order(by_frame) == order(by_index)
    assert "evidence-lists" not in by_frame._jdf.queryExecution().toString()


def test_documents_by_term_against_groups_of_queries(monkeypatch):
    """Blocks and groups cut anywhere give the best of each block; only common terms are laid out for every document."""
    monkeypatch.setattr(scoring, "MOST_ELEMENTS", 200)
    monkeypatch.setattr(scoring, "SPARSE_TILE", 3)
    rng = np.random.default_rng(4)

    def batches(n, width, ids):
        rows = [np.flatnonzero(rng.random(width) < rng.random() * np.linspace(1, 0.02, width)) for _ in range(n)]
        values = [rng.choice([0.25, 0.5, 1.0], len(r)) for r in rows]
        arrays = [pa.array(ids), pa.array([r.tolist() for r in rows], pa.list_(pa.int32())), pa.array([v.tolist() for v in values], pa.list_(pa.float64()))]
        whole = pa.RecordBatch.from_arrays(arrays, names=list("abc"))
        matrix = np.zeros((n, 60))
        for i, (r, v) in enumerate(zip(rows, values)):
            matrix[i, r] = v
        return [whole.slice(at, 7) for at in range(0, n, 7)], matrix

    ids = rng.permutation(90).tolist()
    documents, rows = batches(90, 50, ids)
    queries, asked = batches(20, 60, list(range(100, 120)))
    blocks = list(scoring.packed_postings(documents, 32))
    groups = list(scoring.packed_queries(queries, 8))
    listed = [i for block in blocks for i in block.column(0)[0].as_py()]
    assert len(blocks) > 3 and sorted(listed) == sorted(ids) and len(groups) >= 3
    at = {i: n for n, i in enumerate(ids)}
    for block in blocks:
        inside = block.column(0)[0].as_py()
        assert inside == sorted(inside)
        for group in groups:
            cell = pa.RecordBatch.from_arrays(group.columns + block.columns, names=list("abcdefgh"))
            found = {}
            for batch in scoring.grid_top_k([cell], 3):
                for q, i, sim in zip(*(column.to_pylist() for column in batch.columns)):
                    found.setdefault(q, []).append((i, sim))
            for q in group.column(0)[0].as_py():
                sims = {i: round(float(asked[q - 100] @ rows[at[i]]), 9) for i in inside}
                assert found[q] == sorted(sims.items(), key=lambda x: (-x[1], x[0]))[:3]
    starts, places, weights = (scoring._held(blocks[0].column(c)[0], kind) for c, kind in ((1, np.int64), (2, np.int32), (3, float)))
    held = scoring.Block(len(blocks[0].column(0)[0].values), starts, places, weights)
    assert len(held.common) == (np.diff(starts) * scoring.COMMON_SHARE >= held.rows).sum() < len(held.counts)


def test_dense_queries_are_all_rows(spark, tmp_path):
    rows = [(i, [math.cos(i), math.sin(i), 0.1], i % 3) for i in range(50)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = q_model.dense_neighbours(spark, str(tmp_path)).collect()
    assert sorted({r["query_id"] for r in found}) == list(range(50)) and len(found) == 150
    assert all(r["incident_id"] == r["query_id"] for r in found if r["rank"] == 1)


def test_dense_vectors_without_direction_rank_last(spark, monkeypatch):
    """A null vector has no similarity and a zero vector that of 0; groups, pieces and runs end anywhere."""
    monkeypatch.setattr(retrieval, "DENSE_QUERIES", 3)
    monkeypatch.setattr(retrieval, "DENSE_ROWS", 5)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(40)] + [(40, None), (41, [0.0] * 4), (42, None)]
    frame = spark.createDataFrame(rows, "incident_id long, embedding array<float>").repartition(3)
    ranked = retrieval.top_dense(frame.withColumnRenamed("incident_id", "query_id"), frame, 4).collect()
    unit = {i: None if v is None else np.array(v) / (np.linalg.norm(v) or 1.0) for i, v in rows}

    def best(query):
        sims = {i: None if v is None or unit[query] is None else round(float(unit[query] @ v), 9) + 0.0 for i, v in unit.items()}
        return sorted(sims.items(), key=lambda x: (x[1] is None, -(x[1] or 0.0), x[0]))[:4]

    found = {}
    for r in sorted(ranked, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["incident_id"], r["similarity"]))
    assert found == {i: best(i) for i, _ in rows}


def test_best_places_in_pieces():
    """Ties within rounding go to the lower place, wherever pieces and runs are cut."""
    rng = np.random.default_rng(5)
    sims = rng.integers(0, 6, (7, 500)) / 5 + rng.normal(size=(7, 500)) * 1e-11
    sims[3], sims[4, ::2], sims[5] = np.nan, np.nan, 0.5
    for width in (500, 130, 64, 7):
        best = scoring.Best(7, 3)
        for first in range(0, 500, width):
            best.add(sims[:, first : first + width], first)
        row, place, _ = best.result()
        for i in range(7):
            want = sorted(range(500), key=lambda j: (np.isnan(sims[i, j]), -np.round(np.nan_to_num(sims[i, j]), 9), j))[:3]
            assert place[row == i].tolist() == want


def test_winners_go_to_the_rows_they_show(spark):
    """Of a corpus beyond the broadcast threshold the narratives are not shuffled to the few rows found."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        rows = [(i, f"pump {i % 9} leaked fuel near valve {i} " + "x" * (i % 50), "Fuel", "Aviation") for i in range(3000)]
        corpus = spark.createDataFrame(rows, "incident_id long, narrative string, label string, domain string")
        model = features.fit_tfidf(features.add_processed(corpus))
        asked = spark.createDataFrame([(1, "valve 2107 leaked")], "query_id long, narrative string")
        index = retrieval.build_index(corpus, model, snippet_chars=None)
        ranked = retrieval.top_evidence(retrieval.query_vectors(asked, model), index, 1)
        assert [r["snippet"] for r in ranked.collect()] == [rows[2107][1]]
        assert "Exchange hashpartitioning" not in ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
