"""Evidence: the most similar past incidents of each query, by cosine of unit vectors.

Term vectors of a stored index are looked up in an inverted index (`postings`), kept in buckets beside the
vectors; those of a frame, and dense ones, meet in a grid of query groups and corpus blocks, in one plan for
any number of queries: each pair of a group and a block lets only the best k per query out, and these are
ranked in a final window.

Ties go to the lower id. A query without any known term gets the lowest ids at similarity 0.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import schema
from faultline.functions.text import normalise, snippet
from faultline.operators import scoring
from faultline.operators.features import TfidfModel, sparse_parts
from faultline.operators.postings import Postings, build_postings, candidates, nearest
from faultline.operators.requests import check_parameters
from faultline.session import committed_versions, mark_complete, materialise, read_buckets, write_buckets

# Queries a task scores at a time, as one matrix over the terms they use.
QUERIES_IN_GROUP = 1024
# Documents of a block that meets groups of queries.
BLOCK_ROWS = 32_768
# The same for dense vectors, which are short.
DENSE_QUERIES = 4096
DENSE_ROWS = 16_384


def _normalised(df: DataFrame, text: str, profile: str) -> Column:
    if profile == "core" and "processed_text" in df.columns:
        return F.col("processed_text")
    return normalise(F.col(text), profile)


def build_index(
    corpus: DataFrame,
    model: TfidfModel,
    profile: str = "core",
    id_col: str = "incident_id",
    snippet_chars: int | None = schema.EVIDENCE_CHARS,
) -> DataFrame:
    """One row per incident: its vector as two arrays and what an evidence entry shows.

    Build one index per text profile. `snippet_chars=None` keeps the whole narrative. A corpus that
    carries `processed_text` has it used for the core profile.
    """
    shown = F.col("narrative") if snippet_chars is None else snippet(F.col("narrative"), snippet_chars)
    rows = corpus.select(
        F.col(id_col).alias("incident_id"),
        _normalised(corpus, "narrative", profile).alias("processed_text"),
        F.col("label"),
        F.coalesce("domain", F.lit("")).alias("domain"),
        shown.alias("snippet"),
    )
    return sparse_parts(model.transform(rows).drop("processed_text"))


@dataclass
class EvidenceIndex:
    """Vectors with what an entry shows, and the inverted index over them."""

    rows: DataFrame
    postings: Postings


def indexed(index: DataFrame | EvidenceIndex) -> EvidenceIndex:
    """The inverted index of an index frame, for one use; `save_index` keeps one."""
    if isinstance(index, EvidenceIndex):
        return index
    rows = materialise(index, "evidence-rows")
    found = build_postings(rows)
    return EvidenceIndex(rows, Postings(materialise(found.lists, "evidence-lists"), found.terms))


def save_index(index: DataFrame, path: str, buckets: int | None = None) -> str:
    """Write the next version: vectors in buckets of the incident, lists in buckets of the list, the terms, the layout."""
    spark = index.sparkSession
    versions = committed_versions(spark, path)
    target = f"{path}/version={versions[-1] + 1 if versions else 1}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_buckets(index, f"{target}/rows", "incident_id", buckets)
    rows = read_buckets(spark, f"{target}/rows", index.schema, "incident_id", buckets)
    found = build_postings(rows)
    write_buckets(found.lists, f"{target}/lists", "list_no", buckets, ("block",))
    found.terms.write.parquet(f"{target}/terms")
    layout = [(buckets, rows.schema.json(), found.lists.schema.json())]
    spark.createDataFrame(layout, "buckets int, rows string, lists string").write.json(f"{target}/layout")
    mark_complete(spark, target)
    return target


def load_index(spark, path: str) -> EvidenceIndex:
    versions = committed_versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no evidence index at {path}")
    target = f"{path}/version={versions[-1]}"
    layout = spark.read.schema("buckets int, rows string, lists string").json(f"{target}/layout").first()
    rows, lists = (T.StructType.fromJson(json.loads(layout[name])) for name in ("rows", "lists"))
    return EvidenceIndex(
        read_buckets(spark, f"{target}/rows", rows, "incident_id", layout["buckets"]),
        Postings(
            read_buckets(spark, f"{target}/lists", lists, "list_no", layout["buckets"]),
            spark.read.parquet(f"{target}/terms"),
        ),
    )


def query_vectors(
    queries: DataFrame, model: TfidfModel, profile: str = "core", id_col: str = "query_id", text: str = "narrative"
) -> DataFrame:
    normalised = _normalised(queries, text, profile).alias("processed_text")
    rows = queries.select(F.col(id_col).alias("query_id"), normalised)
    return sparse_parts(model.transform(rows).drop("processed_text"))


def _rank(local: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "incident_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _cells(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every packed group of queries beside every packed block of rows, groups dealt out to tasks of their own."""
    groups = asked.repartition(max(1, asked.count()))
    return groups.hint("shuffle_replicate_nl").crossJoin(blocks)


def _dense_top_k(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Ranked rows of the index for every query, with what the index shows of them.

    Groups of queries meet blocks of rows as packed rows of vectors, written once. Each pair of a group and
    a block passes on its best k per query, and the rows to show are joined to the winners.
    """
    scoring.travel_with_tasks()
    pack, score = scoring.packed_dense, scoring.dense_top_k

    def packed(frame: DataFrame, id_col: str, rows: int, prefix: str) -> DataFrame:
        kind = frame.schema[id_col].dataType.simpleString()
        layout = f"{prefix}_ids array<{kind}>, {prefix}_size int, {prefix}_vectors binary"
        made = frame.select(id_col, "embedding").mapInArrow(lambda batches: pack(batches, rows), layout)
        return materialise(made, "evidence-blocks")

    asked = packed(queries, "query_id", DENSE_QUERIES, "q")
    cells = _cells(asked, packed(index, "incident_id", DENSE_ROWS, "d"))
    out_schema = T.StructType(
        [queries.schema["query_id"], index.schema["incident_id"], T.StructField("similarity", T.DoubleType())]
    )
    found = _rank(cells.mapInArrow(lambda batches: score(batches, k), out_schema), k)
    shown = [name for name in index.columns if name not in ("incident_id", "embedding")]
    return found.join(index.select("incident_id", *shown), "incident_id")


def _sparse_top_k(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Ranked (query_id, incident_id, similarity) of written tables of vectors, every document scored.

    Blocks of documents, by term, meet groups of queries as packed rows; each pair of a block and a group passes on its
    best k per query. The blocks are written where more than one group of queries reads them.
    """
    scoring.travel_with_tasks()
    by_query, by_term, score = scoring.packed_queries, scoring.packed_postings, scoring.grid_top_k

    def packed(frame: DataFrame, id_col: str, prefix: str, parts: tuple[str, ...], pack, most: int) -> DataFrame:
        kind = frame.schema[id_col].dataType.simpleString()
        layout = ", ".join([f"{prefix}_ids array<{kind}>", *(f"{prefix}_{part} binary" for part in parts)])
        held = frame.filter(F.col(id_col).isNotNull()).select(id_col, "indices", "values")
        return held.mapInArrow(lambda batches: pack(batches, most), layout)

    def few(frame: DataFrame, most: int) -> DataFrame:
        return frame.coalesce(max(1, -(-frame.count() // most)))

    queries = few(asked, QUERIES_IN_GROUP)
    groups = packed(queries, "query_id", "q", ("sizes", "indices", "values"), by_query, QUERIES_IN_GROUP)
    groups = materialise(groups, "evidence-groups")
    single = groups.count() <= 1
    blocks = packed(
        rows if single else few(rows, BLOCK_ROWS), "incident_id", "d", ("starts", "places", "weights"), by_term, BLOCK_ROWS
    )
    cells = _cells(groups, blocks if single else materialise(blocks, "evidence-blocks"))
    out = T.StructType(
        [asked.schema["query_id"], rows.schema["incident_id"], T.StructField("similarity", T.DoubleType())]
    )
    return _rank(cells.mapInArrow(lambda batches: score(batches, k), out), k)


def top_evidence(
    queries: DataFrame, index: DataFrame | EvidenceIndex, k: int = schema.EVIDENCE_TOP_K
) -> DataFrame:
    """(query_id, rank, similarity, incident_id, label, domain, snippet) of the k nearest incidents.

    `queries` has one row per query id with the vector of `query_vectors`. A stored index is looked up; a
    frame is scored whole, which for one use costs less than building the inverted index.
    """
    check_parameters(top_k=k)
    asked = materialise(queries.select("query_id", "indices", "values"), "evidence-queries")
    if isinstance(index, EvidenceIndex):
        rows, found = index.rows, nearest(asked, index.rows, index.postings, k)
    else:
        rows = materialise(index, "evidence-rows")
        found = _sparse_top_k(asked, rows, k)
    # The winners are written, so that few of them go to the rows and what these show stays where it lies.
    return materialise(found, "evidence-winners").join(rows.drop("indices", "values"), "incident_id")


def documents_scored(
    queries: DataFrame, index: DataFrame | EvidenceIndex, k: int = schema.EVIDENCE_TOP_K
) -> DataFrame:
    """(query_id, scored): how many documents a look-up scores on their whole vectors, besides a few per wanted one."""
    held = indexed(index)
    asked = materialise(queries.select("query_id", "indices", "values"), "evidence-queries")
    counted = candidates(asked, held.rows, held.postings, k).groupBy("query_id").agg(F.count("*").alias("scored"))
    return asked.select("query_id").join(counted, "query_id", "left").fillna(0, ["scored"])


def top_dense(queries: DataFrame, vectors: DataFrame, k: int = schema.EVIDENCE_TOP_K) -> DataFrame:
    """The same over an `embedding` array column instead of term vectors."""
    check_parameters(top_k=k)
    return _dense_top_k(queries, vectors, k)


def evidence_arrays(ranked: DataFrame) -> DataFrame:
    """One row per query with its evidence entries in rank order."""
    entry = F.struct(F.col("rank").cast("int").alias("rank"), "similarity", "label", "domain", "snippet")
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("evidence"))


def explain(
    incidents: DataFrame,
    index: DataFrame | EvidenceIndex,
    model: TfidfModel,
    profile: str = "core",
    k: int = schema.EVIDENCE_TOP_K,
    id_col: str = "incident_id",
) -> DataFrame:
    """Add the evidence array to a table of incidents."""
    ranked = top_evidence(query_vectors(incidents, model, profile, id_col), index, k)
    return incidents.join(
        evidence_arrays(ranked).withColumnRenamed("query_id", id_col), id_col, "left"
    )
