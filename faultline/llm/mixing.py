"""Mixing of sources to target weights by weighted sampling without replacement.

A document's key is an exponential variate divided by its quality weight (Efraimidis-Spirakis):
reading a source in key order draws documents with chances by weight. A source whose target is
over its size is first taken whole as often as it fits; the rest is the head of the key order
whose sizes come nearest to what is left. DataFrame functions only.

Defined results: a null text has size 0 and is never a fraction of the mix; a null source is a
source of its own and the last; a null doc_id counts as the text "null"; rows of one id draw apart
where their texts differ; repeated rows have one key and are drawn one by one; an empty table gives no
rows; other columns, whatever their names, are ignored or passed through.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
NOISE = r"[#*$%&|<>!]"
MOST_EPOCHS = 3
WEIGHTS = (1.0, 2.0, 3.0)
# Key order is cut into this many equal bands per source; only the band a cut lies in is ranked.
BANDS = 8192
# Equal rows are dealt into this many parts, so that no task ranks all copies of one document.
SALTS = 1024


def quality_weight(text: Column) -> Column:
    """1 for text without noise characters, falling to 1/4 where they are a fifth of the characters or more."""
    share = F.regexp_count(text, F.lit(NOISE)) / F.greatest(F.length(text), F.lit(1))
    return F.lit(1.0) - F.least(share * 3.75, F.lit(0.75))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number inside (0, 1) from the id and the text alone: 52 bits of an MD5."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(text))
    bits = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def targets(sources: DataFrame, most: int = MOST_EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Target of each source of (source, source_size): one row per source throughout.

    A source stops at `most` times its size and the others share the rest by weight. In the order
    of size over weight the sources that stop come first, so running sums find the level.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.lit(list(weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("w", w).withColumn("ratio", F.col("source_size") / F.col("w"))
    total = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(total) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_w = F.sum("w").over(total) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / open_w).withColumn("place", F.row_number().over(by_ratio))
    # the first source that does not reach its stop sets the level for all after it
    found = F.min(F.when(most * F.col("ratio") >= F.col("level"), F.struct("place", "level"))).over(total)["level"]
    return level.withColumn("found", found).select(
        "source",
        "source_size",
        F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("found"), F.lit(0.0)) * F.col("w")).alias("target"),
    )


def _drawn(docs: DataFrame, most: int, weights: tuple[float, ...], bands: int, weight: Callable, carry: bool) -> DataFrame:
    """Every row with its source's target and its takes; with `carry` the columns of `docs` as _in0, _in1, ..."""
    columns = docs.columns
    names = [f"_in{i}" for i in range(len(columns))]
    place = dict(zip(columns, names, strict=True))
    held = docs.toDF(*names)
    plain, doc_id = F.col(place["text"]).cast("string"), F.col(place["doc_id"]).cast("long")
    text = F.coalesce(plain, F.lit(""))
    key = -F.log(uniform(doc_id, text)) / weight(text)
    rows = held.select(
        doc_id.alias("doc_id"),
        F.col(place["source"]).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(plain).alias("digest"),
        key.alias("key"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"),
        *(names if carry else []),
    )
    rows = materialise(rows.withColumn("band", F.floor((1 - F.exp(-F.col("key"))) * bands).cast("int")), "mix-rows")
    # Sizes per (source, band) come first; a source never meets in one task.
    sums = rows.groupBy("source", "band").agg(F.sum("size").alias("band_size"))
    goals = targets(sums.groupBy("source").agg(F.sum("band_size").alias("source_size")), most, weights)
    goals = goals.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    earlier = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sums.withColumn("before", F.coalesce(F.sum("band_size").over(earlier), F.lit(0)))
        .withColumnRenamed("source", "s")
        .join(goals, F.col("s").eqNullSafe(F.col("source")))
    )
    # One row per source: the band its cut lies in. Bands before it are in the mix, later ones are not.
    beyond = F.col("before") + F.col("band_size") > F.col("rest")
    per_source = ["source_size", "target", "epochs", "rest"]
    cuts = placed.groupBy("s", *per_source).agg(F.min(F.when(beyond, F.struct("band", "before"))).alias("cut"))
    cuts = materialise(cuts.select("s", *per_source, F.col("cut.band").alias("cut_band"), F.col("cut.before").alias("before")), "mix-cuts")
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("s")))
    cut = joined.filter(F.col("band") == F.col("cut_band"))
    # Equal rows of the cut band are counted per salt and only the counts are put in order.
    same = ["source", "band", "key", "doc_id", "size", "digest", "salt"]
    running = Window.partitionBy("source", "band").orderBy(*same[2:]).rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*same, "before").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum(F.col("n") * F.col("size")).over(running), F.lit(0))
    parts = materialise(parts.select(*same, (F.col("before") + ahead).alias("ahead")), "mix-parts")
    parts = parts.toDF(*[f"p_{name}" for name in same], "ahead")
    met = functools.reduce(Column.__and__, [F.col(name).eqNullSafe(F.col(f"p_{name}")) for name in same])
    number = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))) - 1
    # the document a cut falls into is taken if more than half of it lies before the cut
    extra = F.col("size") < 2 * (F.col("rest") - F.col("ahead") - number * F.col("size"))
    ranked = cut.join(parts, met).withColumn("extra", extra.cast("long")).select(*joined.columns, "extra")
    whole = joined.filter(~F.col("band").eqNullSafe(F.col("cut_band")))
    whole = whole.withColumn("extra", F.coalesce(F.col("band") < F.col("cut_band"), F.lit(True)).cast("long"))
    return whole.unionByName(ranked).withColumn(
        "times", F.col("epochs") + F.when(F.col("size") > 0, F.col("extra")).otherwise(0)
    )


def draw(
    docs: DataFrame,
    most: int = MOST_EPOCHS,
    weights: tuple[float, ...] = WEIGHTS,
    bands: int = BANDS,
    weight: Callable[[Column], Column] = quality_weight,
) -> DataFrame:
    """doc_id, size, source, source_size, target, times (whole takes) and taken of every row.

    `weight` gives the positive quality weight of a text column.
    """
    found = _drawn(docs, most, weights, bands, weight, carry=False)
    taken = (F.col("times") * F.col("size")).alias("taken")
    return found.select("doc_id", "size", "source", "source_size", "target", "times", taken)


def mix_rows(
    docs: DataFrame,
    most: int = MOST_EPOCHS,
    weights: tuple[float, ...] = WEIGHTS,
    bands: int = BANDS,
    weight: Callable[[Column], Column] = quality_weight,
) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it. Rows carry their columns along: nothing is joined back."""
    taken = _drawn(docs, most, weights, bands, weight, carry=True).filter("times > 0")
    copies = taken.withColumn("take", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return copies.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)])
