"""Cleaning and merging of incident tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema
from faultline.functions.text import snippet, strip
from faultline.session import can_broadcast, materialise

MAX_KEPT_LABELS = 10_000
# Bits that mark which texts may be repeated: 4,096 rows of 4 KB, 16 MB for any table.
MARK_BITS = 1 << 27


def primary_label(label: Column) -> Column:
    """First label of a `;`-separated list."""
    return strip(F.split_part(label, F.lit(";"), F.lit(1)))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def top_labels(df: DataFrame, k: int = schema.TOP_LABELS, label: str = "label") -> DataFrame:
    """The k most frequent labels; the bucket label itself is no candidate."""
    if k > MAX_KEPT_LABELS:
        raise ValueError(f"at most {MAX_KEPT_LABELS} labels can be kept")
    return (
        label_counts(df.filter(F.col(label) != schema.OTHER), label)
        .orderBy(F.desc("n"), label)
        .limit(k)
    )


def rare_labels(df: DataFrame, k: int = schema.TOP_LABELS, label: str = "label") -> DataFrame:
    """Labels outside the top k with their counts: what bucketing will merge."""
    return label_counts(df, label).join(top_labels(df, k, label).select(label), label, "left_anti")


def replace_rare(df: DataFrame, kept: DataFrame, label: str = "label", domain: str | None = None) -> DataFrame:
    """Replace labels that are not in `kept` by the bucket label, in one domain or everywhere.

    `kept` comes from `top_labels`, so its size is bounded by a checked k.
    """
    names = F.broadcast(kept.select(F.col(label).alias("_kept")))
    rare = F.col(label).isNotNull() & F.col("_kept").isNull()
    if domain is not None:
        rare = rare & (F.col("domain") == domain)
    replaced = F.when(rare, schema.OTHER).otherwise(F.col(label))
    return df.join(names, F.col(label) == F.col("_kept"), "left").withColumn(label, replaced).drop("_kept")


def bucket_rare_labels(df: DataFrame, k: int = schema.TOP_LABELS, label: str = "label") -> DataFrame:
    """Replace every label outside the top k by the bucket label."""
    return replace_rare(df, top_labels(df, k, label), label)


def tag_domain(df: DataFrame, domain: str) -> DataFrame:
    return df.withColumn("domain", F.lit(domain))


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["narrative", "label"])


def drop_short(df: DataFrame, min_chars: int = schema.MIN_NARRATIVE_CHARS) -> DataFrame:
    return df.filter(F.length("narrative") > min_chars)


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by `order`, which must be unique within a key.

    For short keys. A partial aggregate keeps one row per key and task before the shuffle, so a
    key that a third of all rows share costs no more than any other. The hash shortens the sort.
    """
    others = [name for name in df.columns if name != key and name not in order]
    first = F.min(F.struct(*order, *others)).alias("_first")
    grouped = df.groupBy(F.xxhash64(key).alias("_hash"), key).agg(first)
    return grouped.select(
        *[F.col(name) if name == key else F.col(f"_first.{name}").alias(name) for name in df.columns]
    )


def first_of_each_text(df: DataFrame, order: list[str], text: str = "narrative") -> DataFrame:
    """One row per text, the first by `order`; null texts are one text.

    Digests are grouped, not texts: a partial minimum per task sends each digest on once, however
    many copies there are. What comes back is the row to keep of each text that occurs more than
    once, written out; rows are tested against that list. Up to the broadcast threshold the list
    goes to the rows. Beyond it a bitmap of fixed size does, and only rows it marks as possible
    copies are shuffled to the list; the rows are the same.
    """
    digest = F.coalesce(F.unhex(F.sha2(F.col(text), 256)), F.lit(b""))
    place = F.struct(*order)
    repeated = (
        df.select(digest.alias("_digest"), place.alias("_place"))
        .groupBy("_digest")
        .agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .select("_digest", "_first")
    )
    listed = materialise(repeated, "repeated-texts")
    marked = df.withColumn("_digest", digest)
    if can_broadcast(listed):
        single, copies = None, marked
    else:
        flagged = with_mark(marked, mark_bitmap(listed))
        single, copies = flagged.filter(~F.col("_marked")).select(*df.columns), flagged.filter("_marked")
    tested = copies.join(listed, "_digest", "left")
    firsts = tested.filter(F.col("_first").isNull() | (F.col("_first") == place)).select(*df.columns)
    return firsts if single is None else single.unionByName(firsts)


def _mark_place(digest: str) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(MARK_BITS)) + 1


def mark_bitmap(listed: DataFrame, digest: str = "_digest") -> DataFrame:
    """(bitmap_no, bits): a bit for each digest; at most MARK_BITS / 32,768 rows."""
    at = _mark_place(digest)
    placed = listed.select(F.bitmap_bucket_number(at).alias("bitmap_no"), F.bitmap_bit_position(at).alias("_bit"))
    bits = placed.groupBy("bitmap_no").agg(F.bitmap_construct_agg("_bit").alias("bits"))
    return materialise(bits, "repeated-marks")


def with_mark(df: DataFrame, bitmap: DataFrame, digest: str = "_digest") -> DataFrame:
    """Add `_marked`: whether the bitmap has the row's bit. Some rows that are not listed have it, all listed do."""
    at = _mark_place(digest)
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = (F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2) == 1
    joined = df.join(F.broadcast(bitmap), F.bitmap_bucket_number(at) == F.col("bitmap_no"), "left")
    return joined.withColumn("_marked", F.coalesce(hit, F.lit(False))).drop("bitmap_no", "bits")


def merge_domains(
    aviation: DataFrame | None,
    power: DataFrame | None,
    k: int = schema.TOP_LABELS,
    min_chars: int = schema.MIN_NARRATIVE_CHARS,
) -> DataFrame:
    """The clean incident table of (incident_id, narrative, label) frames of both domains.

    Aviation labels are reduced to their primary one. Which of them are rare is decided before any
    row is dropped; they are replaced last, so finding copies has no need of the label counts. On
    equal narratives the aviation row, then the lowest id, stays.
    """
    frames, kept_labels = [], None
    if aviation is not None:
        primary = aviation.withColumn("label", primary_label(F.col("label")))
        kept_labels = top_labels(primary, k)
        frames.append(tag_domain(primary, schema.AVIATION).withColumn("_rank", F.lit(0)))
    if power is not None:
        frames.append(tag_domain(power, schema.POWER).withColumn("_rank", F.lit(1)))
    if not frames:
        raise RuntimeError("no source to merge")
    merged = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    complete = drop_short(drop_incomplete(merged), min_chars)
    unique = first_of_each_text(complete, ["_rank", "incident_id"]).drop("_rank")
    return unique if kept_labels is None else replace_rare(unique, kept_labels, domain=schema.AVIATION)


def domain_counts_row(df: DataFrame) -> DataFrame:
    """Rows per domain and in total, as one row."""
    return df.agg(
        F.count_if(F.col("domain") == schema.AVIATION).alias("aviation_count"),
        F.count_if(F.col("domain") == schema.POWER).alias("power_grid_count"),
        F.count("*").alias("total_count"),
    )


def preview(
    df: DataFrame, order_by: str, rows: int = schema.PREVIEW_ROWS, chars: int = schema.PREVIEW_CHARS
) -> DataFrame:
    return (
        df.orderBy(order_by)
        .limit(rows)
        .select(order_by, snippet(F.col("narrative"), chars).alias("narrative"), "domain", "label")
    )
