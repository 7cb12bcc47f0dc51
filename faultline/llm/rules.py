"""Quality rules with cutoffs that limit false rejections, learnt from labelled documents.

Each rule rejects a document whose statistic lies above the cutoff of its stratum (the language).
For a stratum the cutoffs are tried from the mildest on; a cutoff is certified when an exact
binomial test on the labelled good documents rules out that more than `risk` of them are lost,
and the first that cannot be certified ends the sequence. The error level is shared out over all
strata and rules (Bonferroni), and the allowed loss over the rules. Among certified cutoffs the one
that best tells labelled good from bad is used; a stratum with too few labels gets none.

Defined results: a null or empty text has no words and fails the base rules; a null language is a
stratum; a document with labels that differ counts as bad; repeated rows are judged one by one, a
labelled id counts once per distinct row of statistics; empty tables give no rows or no cutoffs;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import textstats
from faultline.session import materialise

RULES = ("symbols", "copied_lines", "repeats", "shouting")
# Cutoffs lie on a grid of this many steps between 0 and 1.
STEPS = 200
# At most this share of good documents may be lost to all rules, with this chance of error at most.
RISK = 0.04
ERROR = 0.05
LEAST_WORDS = 20
MOST_REPEATS = 30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIELDS = ["doc_id", "lang", *COUNTS, *RULES]


def grid(part: int, whole: int, steps: int = STEPS) -> int:
    """`part / whole` rounded up to the grid: 0 only for 0."""
    return -(-part * steps // whole) if whole else 0


def document_statistics(text: str | None) -> list[int]:
    """The base counts and the rules' statistics of a whole text."""
    text = text or ""
    words = textstats.WORD.findall(text)
    lines, copied = textstats.line_counts(text)
    chars = sum(map(len, words))
    symbols = len(textstats.SYMBOL.findall(text))
    repeats = textstats.words_in_repeats(words)
    shouted = sum(1 for w in words if len(w) > 1 and w.isupper())
    n = len(words)
    shares = [grid(symbols, chars), grid(copied, lines), grid(repeats, n), grid(shouted, n)]
    return [n, chars, symbols, copied, repeats, *shares]


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row of statistics for each row of `docs`; with `carry`, its columns too, as _in0, _in1, ..."""
    columns = docs.columns
    text, lang, doc_id = (columns.index(c) for c in ("text", "lang", "doc_id"))
    held = docs.toDF(*[f"_in{i}" for i in range(len(columns))])
    wanted = list(range(len(columns))) if carry else [text, lang, doc_id]
    held = held.select(*[f"_in{i}" for i in wanted])
    counted = T.StructType(list(held.schema.fields[0 if carry else 1 :]))
    for name in FIELDS[2:]:
        counted = counted.add(name, T.LongType() if name in COUNTS else T.IntegerType())
    place = held.columns.index(f"_in{text}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textstats.in_slices(batches):
            rows = [document_statistics(t) for t in batch.column(place).to_pylist()]
            found = list(zip(*rows, strict=True)) or [()] * (len(FIELDS) - 2)
            kinds = [pa.int64()] * len(COUNTS) + [pa.int32()] * len(RULES)
            new = [pa.array(c, type=kind) for c, kind in zip(found, kinds, strict=True)]
            old = batch.columns if carry else batch.columns[1:]
            names = batch.schema.names if carry else batch.schema.names[1:]
            yield pa.RecordBatch.from_arrays([*old, *new], names=[*names, *FIELDS[2:]])

    out = held.mapInArrow(run, counted)
    keys = [
        F.col(f"_in{doc_id}").cast("long").alias("doc_id"), F.col(f"_in{lang}").cast("string").alias("lang")
    ]
    carried = [f"_in{i}" for i in wanted] if carry else []
    return out.select(*keys, *FIELDS[2:], *carried)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATS * n_words)


def binomial_tail(k: int, n: int, p: float) -> float:
    """Chance of at most k of n at rate p, exactly."""
    if k >= n:
        return 1.0
    log_p, log_q = math.log(p), math.log1p(-p)
    whole = math.lgamma(n + 1)
    terms = (
        whole - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q for i in range(k + 1)
    )
    return min(1.0, math.fsum(map(math.exp, terms)))


def pick(good: list[int], bad: list[int], risk: float, error: float) -> int | None:
    """Cutoff from counts by grid value: certified from the mildest on, then the best of those certified."""
    n_good, n_bad = sum(good), sum(bad)
    best, cutoff = 0.0, None
    lost = caught = 0
    for step in range(len(good) - 2, -1, -1):  # rejects values above `step`
        lost += good[step + 1]
        caught += bad[step + 1]
        if n_good == 0 or binomial_tail(lost, n_good, risk) > error:
            break
        gain = caught / max(n_bad, 1) - lost / n_good
        if gain > best:
            best, cutoff = gain, step
    return cutoff


def cutoffs(
    stats: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, steps: int = STEPS
) -> DataFrame:
    """(stratum, one cutoff per rule): null where none could be certified. One row per stratum."""
    marked = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("labelled_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    held = stats.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    values = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("value")) for rule in RULES]))
    # Counts per (stratum, rule, grid value, label): a few hundred rows for a stratum of any size.
    counts = (
        held.select(*FIELDS).join(marked, F.col("doc_id") == F.col("labelled_id"))
        .dropDuplicates(FIELDS)  # repeats of a row are one trial of the test
        .select(F.coalesce("lang", F.lit("")).alias("stratum"), F.col("lang").isNull().alias("none"), "quality", values)
        .groupBy("stratum", "none", "col.rule", "col.value", "quality")
        .agg(F.count("*").alias("n"))
    )
    counts = materialise(counts, "rule-counts")
    strata = counts.select("stratum", "none").distinct().agg(F.count("*").alias("strata"))
    schema = "lang string, " + ", ".join(f"{rule}_cutoff int" for rule in RULES)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        level = error / (len(RULES) * int(part["strata"].iloc[0]))
        row: dict = {"lang": None if part["none"].iloc[0] else part["stratum"].iloc[0]}
        for rule in RULES:
            of_rule = part[part["rule"] == rule]
            good, bad = [0] * (steps + 1), [0] * (steps + 1)
            for value, quality, n in zip(of_rule["value"], of_rule["quality"], of_rule["n"], strict=True):
                (good if quality == 1 else bad)[int(value)] += int(n)
            row[f"{rule}_cutoff"] = pick(good, bad, risk / len(RULES), level)
        out = pd.DataFrame([row])
        return out.astype({f"{rule}_cutoff": "Int32" for rule in RULES})

    # `strata` is one row
    return counts.join(F.broadcast(strata)).groupBy("stratum", "none").applyInPandas(run, schema)


def judge(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """Statistics with `base_failed` and `kept`. `limits` has one row per stratum; its plan decides how it is joined."""
    limits = limits.withColumnRenamed("lang", "stratum").select("stratum", *[f"{rule}_cutoff" for rule in RULES])
    judged = stats.join(limits, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    broken = F.lit(False)
    for rule in RULES:
        broken = broken | F.coalesce(F.col(rule) > F.col(f"{rule}_cutoff"), F.lit(False))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~broken)


def verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the rules' statistics and cutoffs of every row."""
    stats = materialise(statistics(docs), "rule-statistics")
    return judge(stats, materialise(cutoffs(stats, labels, **options), "rule-cutoffs")).drop("stratum")


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that pass, with the columns they came with."""
    stats = materialise(statistics(docs, carry=True), "rule-documents")
    limits = materialise(cutoffs(stats, labels, **options), "rule-cutoffs")
    passed = judge(stats, limits).filter("kept")
    return passed.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)])
