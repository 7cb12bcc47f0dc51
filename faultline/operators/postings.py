"""Inverted index over unit term vectors and exact top-k look-ups that score few documents.

A term's documents are cut into lists, by a hash of the document where the term is in many, and a list into
blocks by falling weight, each with its largest. A look-up works in three steps:

1. The highest blocks of a query's strongest terms give a few documents, scored on their whole vectors. The
   k-th best of them is a bound no worse document can pass.
2. Terms are taken from the rarest on. What is left of the query after a term limits what the others can add
   to any document; terms beyond the point where that falls under a share of the bound are not opened. For
   every document found, products so far and the masses not yet matched limit its whole score.
3. Only documents that can still reach the bound are scored on their whole vectors.

Nothing is lost by the limits: the result is that of scoring every document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators import scoring
from faultline.session import materialise

# Documents per block, and per list of one term.
BLOCK = 128
LIST_DOCUMENTS = 65_536
# Terms whose highest block gives the first documents, and how many of those are scored per wanted one.
SEED_TERMS = 12
SEEDS_PER_RESULT = 4
# Terms are opened until those left can add less than this share of the bound: the lower, the more lists are
# read and the fewer documents are scored.
OPEN_SHARE = 0.25
# Scores are ranked by 9 digits; a bound gives way by more than they round.
SLACK = 1e-8


@dataclass
class Postings:
    """`lists`: list_no, block, top, entries (incident_id, weight); `terms`: one row per term of the vocabulary."""

    lists: DataFrame
    terms: DataFrame


def entries_of(index: DataFrame) -> DataFrame:
    """(incident_id, term_no, weight) of every term of every vector: the index as a long table."""
    pairs = F.inline(F.arrays_zip(F.col("indices").alias("term_no"), F.col("values").alias("weight")))
    return index.select("incident_id", pairs)


def build_postings(index: DataFrame, list_documents: int = LIST_DOCUMENTS, block: int = BLOCK) -> Postings:
    """Lists and term directory of an index; a list is never longer than about `list_documents`."""
    entries = entries_of(index)
    counted = entries.groupBy("term_no").agg(F.count("*").alias("df"), F.max("weight").alias("term_top"))
    lists = F.ceil(F.col("df") / list_documents).cast("bigint")
    # One row per term of a vocabulary of checked size: the window and the broadcast below are bounded.
    numbered = counted.withColumn("n_lists", lists).withColumn(
        "first_list", F.sum("n_lists").over(Window.orderBy("term_no")) - F.col("n_lists")
    )
    terms = materialise(numbered, "index-terms")
    own = F.col("first_list") + F.pmod(F.xxhash64("incident_id"), F.col("n_lists"))
    placed = entries.join(F.broadcast(terms.select("term_no", "first_list", "n_lists")), "term_no")
    falling = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("less"), "incident_id")))
    listed = placed.groupBy(own.alias("list_no")).agg(falling.alias("all"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("all") - 1) / block).cast("int"))
    cut = F.transform(numbers, lambda b: F.slice("all", b * block + 1, F.lit(block)))
    blocks = listed.select("list_no", F.posexplode(cut).alias("block", "part")).select(
        "list_no",
        "block",
        (-F.get("part", F.lit(0))["less"]).alias("top"),
        F.transform("part", lambda e: F.struct(e["incident_id"].alias("incident_id"), (-e["less"]).alias("weight"))).alias(
            "entries"
        ),
    )
    return Postings(blocks, terms)


def query_terms(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """The known terms of each query, rarest first: weight `q`, and limits on what other terms can add to a score.

    `onwards` limits the terms from it on, `after` those behind it: the lesser of their norm, as documents have
    norm 1, and the sum of weight times the term's largest weight. A query has at most one row per term of the
    vocabulary, so its windows are bounded.
    """
    pairs = F.inline(F.arrays_zip(F.col("indices").alias("term_no"), F.col("values").alias("q")))
    known = asked.select("query_id", pairs).join(F.broadcast(terms), "term_no")
    rare_first = Window.partitionBy("query_id").orderBy("df", "term_no")
    onwards = rare_first.rowsBetween(0, Window.unboundedFollowing)
    after = rare_first.rowsBetween(1, Window.unboundedFollowing)

    def norm(window) -> Column:
        return F.sqrt(F.coalesce(F.sum(F.col("q") * F.col("q")).over(window), F.lit(0.0)))

    def most(window) -> Column:
        return F.coalesce(F.sum(F.col("q") * F.col("term_top")).over(window), F.lit(0.0))

    strongest = Window.partitionBy("query_id").orderBy(F.desc(F.col("q") * F.col("term_top")), "term_no")
    return known.withColumns(
        {
            "norm": norm(onwards),
            "most": most(onwards),
            "after": F.least(norm(after), most(after)),
            "strength": F.row_number().over(strongest),
        }
    ).withColumn("onwards", F.least("norm", "most"))


def opened(terms: DataFrame, lists: DataFrame, first_only: bool = False) -> DataFrame:
    """The blocks of each query term; `terms` may have a `bound` that a block's documents have to be able to reach."""
    count = F.lit(1).cast("bigint") if first_only else F.col("n_lists")
    numbers = F.sequence(F.col("first_list"), F.col("first_list") + count - 1)
    asked = terms.withColumn("asked_list", F.explode(numbers))
    met = asked.join(lists, F.col("asked_list") == F.col("list_no"))
    if first_only:
        return met.filter("block = 0")
    # Of the last term, blocks too low for a document found in nothing before are left closed.
    return met.filter(~F.col("last") | (F.col("q") * F.col("top") + F.col("after") >= F.col("bound")))


def exact_scores(pairs: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, incident_id, similarity) of chosen pairs, on whole vectors."""
    scoring.travel_with_tasks()
    vectors = index.select("incident_id", F.col("indices").alias("d_indices"), F.col("values").alias("d_values"))
    both = pairs.select("query_id", "incident_id").join(vectors, "incident_id").join(
        asked.select("query_id", F.col("indices").alias("q_indices"), F.col("values").alias("q_values")), "query_id"
    )
    out = T.StructType(
        [asked.schema["query_id"], index.schema["incident_id"], T.StructField("similarity", T.DoubleType())]
    )
    score = scoring.pair_scores
    return both.mapInPandas(lambda batches: score(batches), out)


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "incident_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def candidates(asked: DataFrame, index: DataFrame, postings: Postings, k: int) -> DataFrame:
    """(query_id, incident_id) of every document that can be among the k best of a query."""
    terms = materialise(query_terms(asked, postings.terms), "evidence-terms")
    first = opened(terms.filter(F.col("strength") <= SEED_TERMS), postings.lists, first_only=True)
    entry = first.select("query_id", "q", F.inline("entries"))
    partial = entry.groupBy("query_id", "incident_id").agg(F.sum(F.col("q") * F.col("weight")).alias("similarity"))
    seeds = exact_scores(_best(partial, SEEDS_PER_RESULT * k), asked, index)
    bounds = _best(seeds, k).filter(F.col("rank") == k).select("query_id", (F.col("similarity") - SLACK).alias("bound"))
    bounds = materialise(bounds, "evidence-bounds")
    # Without k documents yet there is no bound, and every document that shares a term stays in.
    bounded = terms.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    # The last term opened may be opened in part, so it counts as unmatched for every document.
    needed = bounded.filter(F.col("onwards") >= OPEN_SHARE * F.col("bound"))
    of_query = Window.partitionBy("query_id")
    needed = needed.withColumns({"open_norm": F.min("norm").over(of_query), "open_most": F.min("most").over(of_query)})
    needed = needed.withColumn("last", F.col("norm") == F.col("open_norm"))
    needed = materialise(needed, "evidence-needed")
    found = opened(needed, postings.lists).select("query_id", "q", F.inline("entries"))
    products = found.groupBy("query_id", "incident_id").agg(
        F.sum(F.col("q") * F.col("weight")).alias("product"), F.sum(F.col("weight") * F.col("weight")).alias("matched")
    )
    limits = materialise(needed.filter("last").select("query_id", "open_norm", "open_most", "bound").distinct(), "evidence-limits")
    unmatched = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("matched")))
    rest = F.least(F.col("open_norm") * unmatched, F.col("open_most"))
    limited = products.join(limits, "query_id")
    return limited.filter(F.col("product") + rest >= F.col("bound")).select("query_id", "incident_id")


def padded(asked: DataFrame, ranked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Ranked rows with those of similarity 0 replaced: the lowest ids fill up to k."""
    positive = materialise(ranked.filter("similarity > 0").select("query_id", "incident_id", "similarity"), "evidence-found")
    short = asked.select("query_id").join(positive.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    short = short.filter(F.coalesce("n", F.lit(0)) < k).select("query_id")
    # k is checked to be 10 at most
    lowest = index.select("incident_id").orderBy("incident_id").limit(2 * k).agg(F.collect_list("incident_id").alias("ids"))
    fill = short.join(F.broadcast(lowest)).select("query_id", F.explode("ids").alias("incident_id"))
    fill = fill.join(positive.select("query_id", "incident_id"), ["query_id", "incident_id"], "left_anti")
    return _best(positive.unionByName(fill.withColumn("similarity", F.lit(0.0))), k)


def nearest(asked: DataFrame, index: DataFrame, postings: Postings, k: int) -> DataFrame:
    """(query_id, incident_id, similarity, rank) of the k best of every query; `asked` is a written table."""
    pairs = candidates(asked, index, postings, k)
    return padded(asked, _best(exact_scores(pairs, asked, index), k), index, k)
