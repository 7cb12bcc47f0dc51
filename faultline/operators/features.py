"""Term vectors: normalised text, vocabulary with counts, smoothed-idf weights of unit length.

Vectors are computed on Arrow batches (`termwork`) with the vocabulary and its weights sent along, so
vectorising a table needs no shuffle; only counting the vocabulary does, behind a count per piece of text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions import lexicon
from faultline.functions.text import normalise, vector_words, with_bigrams
from faultline.operators import termwork
from faultline.session import materialise

# The vocabulary lives on the driver and in every task, so its size is a checked parameter.
MAX_VOCABULARY = 20_000
# A dictionary's look-up tables: bytes of words and lemmas in one, tables in one plan, slots of one.
TABLE_BYTES = 8 << 20
MOST_TABLES = 8
SLOTS = 65_536


def add_processed(df: DataFrame, text: str = "narrative", profile: str = "core") -> DataFrame:
    return df.withColumn("processed_text", normalise(F.col(text), profile))


def lemmatise_by_table(words: DataFrame, lemmas: DataFrame, id_col: str, text: str = "words") -> DataFrame:
    """(id, processed_text) with the nouns of a (word, lemma) dictionary too big for an expression.

    Only entries that occur in the texts and change a word are kept. They lie in look-up tables of checked
    size that every task holds, so the texts are not shuffled; beyond `MOST_TABLES` tables the words are
    joined to the dictionary. A null text stays null; of several lemmas of one word the first in order is taken.
    """
    own = words.select(F.explode(F.split(text, " ")).alias("word")).distinct()
    entries = lemmas.groupBy("word").agg(F.min("lemma").alias("lemma")).filter("word <> lemma")
    used = materialise(entries.join(own, "word", "left_semi"), "lemmas")
    size = used.agg(F.sum(F.octet_length("word") + F.octet_length("lemma"))).first()[0] or 0
    count = -(-size // TABLE_BYTES)
    if count > MOST_TABLES:
        return _lemmatise_by_join(words, used, id_col, text)
    tables = _lookup_tables(used, count) if count else None
    held = words.select(id_col, F.split(text, " ").alias("_words"))
    for i in range(count):
        held = held.withColumn(f"_table{i}", tables.filter(F.col("number") == i).select("slots").scalar())

    def lemma(word: Column) -> Column:
        at = _slot(word, count)
        found = [F.try_element_at(F.get(f"_table{i}", (at - i * SLOTS).cast("int")), word) for i in range(count)]
        return F.coalesce(*found, word)

    lemmatised = F.transform("_words", lemma) if count else F.col("_words")
    return held.select(id_col, F.array_join(lemmatised, " ").alias("processed_text"))


def _slot(word: Column, tables: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(tables * SLOTS))


def _lookup_tables(entries: DataFrame, tables: int) -> DataFrame:
    """(number, slots): each table is an array of small maps, a word lies in the slot of its hash."""
    slot = _slot(F.col("word"), tables).alias("at")
    filled = entries.groupBy(slot).agg(F.collect_list(F.struct("word", "lemma")).alias("entries"))
    slots = entries.sparkSession.range(tables * SLOTS).toDF("at").join(filled, "at", "left")
    rows = slots.groupBy(F.floor(F.col("at") / SLOTS).alias("number")).agg(
        F.sort_array(F.collect_list(F.struct("at", "entries"))).alias("slots")
    )
    maps = F.transform("slots", lambda s: F.when(s["entries"].isNotNull(), F.map_from_entries(s["entries"])))
    return materialise(rows.select("number", maps.alias("slots")), "lemma-tables")


def _lemmatise_by_join(words: DataFrame, lemmas: DataFrame, id_col: str, text: str) -> DataFrame:
    """The same with one row per word; the words of a row meet again under its number."""
    numbered = materialise(words.select(id_col, text, F.monotonically_increasing_id().alias("_row")), "lemma-texts")
    placed = numbered.select("_row", id_col, F.posexplode_outer(F.split(text, " ")).alias("_at", "word"))
    entry = F.struct("_at", F.coalesce("lemma", "word").alias("lemma"))
    ordered = (
        placed.join(lemmas, "word", "left")
        .groupBy("_row")
        .agg(F.first(id_col).alias(id_col), F.sort_array(F.collect_list(entry)).alias("_entries"))
    )
    known = F.get("_entries", 0)["lemma"].isNotNull()
    return ordered.select(id_col, F.when(known, F.array_join("_entries.lemma", " ")).alias("processed_text"))


def with_terms(df: DataFrame, text: str = "processed_text", out: str = "terms") -> DataFrame:
    """Words and neighbouring pairs of a normalised text."""
    words = df.withColumn("_words", vector_words(F.coalesce(F.col(text), F.lit(""))))
    return words.withColumn(out, with_bigrams(F.col("_words"))).drop("_words")


def _ignored() -> frozenset[str]:
    return frozenset(lexicon.STOPWORDS + lexicon.VECTOR_STOPWORDS)


def vocabulary(docs: DataFrame, max_features: int = schema.MAX_FEATURES, text: str = "processed_text") -> DataFrame:
    """The most frequent terms of normalised texts: occurrences `cf`, documents `df`, ties by term.

    Terms are surveyed first: occurrences by hash bucket, and a lower bound on the count the last term kept has, from
    what the commonest terms of every piece of the corpus add up to. Only terms in buckets that reach the bound are
    then counted by name, so neither the table of distinct terms nor its shuffle grows with the rare ones.
    """
    if max_features > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary may hold at most {MAX_VOCABULARY} terms")
    termwork.travel_with_tasks()
    ignored, survey, counts, leaders = _ignored(), termwork.survey, termwork.counts, 2 * max_features
    texts = docs.select(F.col(text).cast("string"))
    found = texts.mapInArrow(lambda batches: survey(batches, ignored, leaders), "bucket int, term string, n bigint")
    found = materialise(found, "term-survey")
    common = found.filter("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    rows, least = common.orderBy(F.desc("n")).limit(max_features).agg(F.count("*"), F.min("n")).first()
    buckets = found.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n"))
    reached = buckets.filter(F.col("n") >= (least if rows == max_features else 0)).select("bucket")
    # At most termwork.BUCKETS numbers, whatever the corpus holds.
    marks = np.zeros(termwork.BUCKETS, dtype=bool)
    marks[[row["bucket"] for row in reached.collect()]] = True
    wanted = np.packbits(marks).tobytes()
    counted = texts.mapInArrow(lambda batches: counts(batches, ignored, wanted), "term string, cf bigint, df bigint")
    totals = counted.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    return totals.orderBy(F.desc("cf"), "term").limit(max_features)


def with_idf(vocab: DataFrame, documents: int) -> DataFrame:
    return vocab.withColumn("idf", F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0)


class TfidfModel(Model, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """A fitted vocabulary: a pipeline stage that adds unit vectors of weighted terms to normalised texts."""

    def __init__(self, terms: Sequence[str] = (), idf: Sequence[float] = (), documents: int = 0):
        super().__init__()
        self.terms, self.idf, self.documents = list(terms), list(idf), documents
        self._setDefault(inputCol="processed_text", outputCol="features")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        termwork.travel_with_tasks()
        held = termwork.Vocabulary(self.terms, self.idf, _ignored())

        def vectors(texts: pa.Array) -> pa.Array:
            return held.column(texts)

        unit = F.arrow_udf(vectors, VectorUDT())
        return dataset.withColumn(self.getOutputCol(), unit(F.col(self.getInputCol()).cast("string")))

    def vocabulary_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, term, weight) for i, (term, weight) in enumerate(zip(self.terms, self.idf))]
        return spark.createDataFrame(rows, "term_no int, term string, idf double")

    def write(self) -> MLWriter:
        return _TfidfWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TfidfReader()


class _TfidfWriter(MLWriter):
    """Parameters as of any stage, the vocabulary with its weights as a table beside them."""

    def __init__(self, model: TfidfModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark, {"documents": self.model.documents})
        self.model.vocabulary_frame(spark).write.parquet(f"{path}/vocabulary")


class _TfidfReader(MLReader):
    def load(self, path: str) -> TfidfModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/vocabulary").orderBy("term_no").collect()
        model = TfidfModel([row["term"] for row in rows], [row["idf"] for row in rows], metadata["documents"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class Tfidf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Counts the vocabulary of a normalised text column; at most `maxFeatures` rows reach the driver."""

    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms kept", TypeConverters.toInt)

    def __init__(self, max_features: int = schema.MAX_FEATURES, text: str = "processed_text", out: str = "features"):
        super().__init__()
        self._set(maxFeatures=max_features, inputCol=text, outputCol=out)

    def _fit(self, dataset: DataFrame) -> TfidfModel:
        text = self.getInputCol()
        documents = dataset.count()
        counted = vocabulary(dataset, self.getOrDefault(self.maxFeatures), text)
        rows = with_idf(counted, documents).select("term", "idf").collect()
        if not rows:
            raise ValueError("no term to build a vocabulary from")
        model = TfidfModel([row["term"] for row in rows], [row["idf"] for row in rows], documents)
        return self._copyValues(model)


def fit_tfidf(df: DataFrame, text: str = "processed_text", max_features: int = schema.MAX_FEATURES) -> TfidfModel:
    return Tfidf(max_features, text).fit(df)


def sparse_parts(df: DataFrame, features: str = "features") -> DataFrame:
    """Split a sparse vector column into `indices` and `values` arrays."""
    vector = F.unwrap_udt(features)
    return df.withColumns({"indices": vector["indices"], "values": vector["values"]}).drop(features)


def term_weights(df: DataFrame, model: TfidfModel, id_col: str = "incident_id") -> DataFrame:
    """The vectors as a long table (id, term, weight)."""
    parts = sparse_parts(model.transform(df).select(id_col, "features"))
    pairs = parts.select(id_col, F.inline(F.arrays_zip("indices", "values")))
    vocab = model.vocabulary_frame(df.sparkSession)
    return pairs.join(F.broadcast(vocab), pairs["indices"] == vocab["term_no"]).select(
        id_col, "term", F.col("values").alias("weight")
    )
