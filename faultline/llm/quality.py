"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of every text are computed once, in tasks, and written out. The trees are fitted on
a bounded sample of labelled rows and flattened into arrays; tasks score batches by walking all
trees at once with numpy.

Defined results: a null text is an empty one and gets a score like any other; a null doc_id is
scored and never learnt from; of labels that differ the lower counts; repeated rows are scored one
by one; without usable labels, or with labels of one kind only, the score is the smoothed share
of label 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import textstats
from faultline.session import materialise

# The trees are fitted on at most this many labelled rows, drawn by a hash of the id.
SAMPLE_ROWS = 20_000
TREES = 80
DEPTH = 4
BINS = 64
RATE = 0.1
LEAST_ROWS = 5
RIDGE = 1.0
THRESHOLD = 0.3
FOLDS = 5

PUNCTUATION = b"*$%&#!|<>.,;:?-_()[]{}@/\\\"'=+~^`"
NAMES = (
    ["chars", "words", "word_length", "longest_word", "distinct_words", "commonest_word", "shouted_words"]
    + ["lines", "copied_lines", "line_words", "repeats", "symbols"]
    + ["digits", "capitals", "small_letters", "beyond_ascii", "spaces", "line_breaks", "controls"]
    + [f"mark_{chr(c)}" for c in PUNCTUATION]
)


def document_features(text: str | None) -> list[float]:
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    seen = np.bincount(raw, minlength=256)
    size = max(len(raw), 1)
    words = textstats.WORD.findall(text)
    n = max(len(words), 1)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines, copied = textstats.line_counts(text)
    letters = seen[65:91].sum() + seen[97:123].sum()
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        np.log1p(max(map(len, counts), default=0)),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n,
        np.log1p(lines),
        copied / max(lines, 1),
        np.log1p(len(words) / max(lines, 1)),
        textstats.words_in_repeats(words) / n,
        len(textstats.SYMBOL.findall(text)) / n,
        seen[48:58].sum() / size,
        seen[65:91].sum() / max(letters, 1),
        seen[97:123].sum() / size,
        seen[128:].sum() / size,
        seen[32] / size,
        seen[10] / size,
        (seen[:32].sum() - seen[9:14].sum()) / size,
        *(seen[list(PUNCTUATION)] / n),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row; nothing but the text goes into them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [document_features(text) for text in batch.column("text").to_pylist()]
            values = np.array(rows, dtype=np.float32).reshape(-1, len(NAMES))
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))],
                names=["doc_id", "features"],
            )

    columns = ("cast(doc_id as long) doc_id", "cast(text as string) text")
    return docs.selectExpr(*columns).mapInArrow(run, "doc_id long, features array<float>")


@dataclass
class Trees:
    """Complete binary trees in flat arrays: node i of a tree has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x (2**depth - 1)
    limit: np.ndarray  # the same shape; above it goes right
    value: np.ndarray  # trees x 2**depth
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row: all trees are walked level by level together."""
        rows = np.arange(len(x))[:, None]
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.limit[tree, node])
        margin = self.base + self.value[tree, node - (2**self.depth - 1)].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-margin))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE
) -> Trees:
    """Boosted trees for the logistic loss, split on histograms of gradients over quantile bins."""
    x = x.astype(np.float32)
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1.0 - share)))
    feature = np.zeros((trees, inner), dtype=np.int64)
    limit = np.full((trees, inner), np.inf, dtype=np.float32)
    value = np.zeros((trees, leaves))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, feature, limit, value, depth)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)])
    wide = bins + 1
    margin = np.full(len(y), base)
    for t in range(trees):
        chance = 1.0 / (1.0 + np.exp(-margin))
        slope, curve = chance - y, chance * (1.0 - chance)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = node - first
            best = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                slot = place * wide + binned[j]
                g, h, c = (
                    np.bincount(slot, weights=w, minlength=width * wide).reshape(width, wide).cumsum(axis=1)
                    for w in (slope, curve, None)
                )
                all_g, all_h, all_c = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = (
                    g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
                )
                gain[(c < LEAST_ROWS) | (all_c - c < LEAST_ROWS)] = 0.0
                gain[:, len(edges[j]) :] = 0.0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for i in np.flatnonzero(top > best):
                    best[i] = top[i]
                    feature[t, first + i], limit[t, first + i] = j, edges[j][at[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > limit[t, node])
        leaf = node - inner
        g = np.bincount(leaf, weights=slope, minlength=leaves)
        h = np.bincount(leaf, weights=curve, minlength=leaves)
        value[t] = -rate * g / (h + RIDGE)
        margin += value[t][leaf]
    return Trees(base, feature, limit, value, depth)


def in_holdout(doc_id):
    """The fixed fold that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(rows: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from the labelled rows outside the holdout; at most `sample_rows` come to the driver."""
    marked = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("labelled_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    known = rows.filter(~in_holdout(F.col("doc_id"))).join(marked, F.col("doc_id") == F.col("labelled_id"))
    # A share of the hash range that holds a little under `sample_rows` rows; all of them where there are
    # fewer. A top-n would send n rows from every partition.
    total = known.count()
    share = min(1.0, 0.95 * sample_rows / max(total, 1))
    drawn = known if total <= sample_rows else known.filter(
        F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < int(share * (1 << 53))
    )
    sample = drawn.select("doc_id", "features", "quality").limit(sample_rows).collect()
    sample.sort(key=lambda r: (r["doc_id"], r["features"]))
    x = np.array([r["features"] for r in sample], dtype=np.float32).reshape(-1, len(NAMES))
    return fit(x, np.array([r["quality"] for r in sample], dtype=float))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = materialise(features(docs), "quality-features")
    trees = learn(rows, labels, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            score = np.concatenate([trees.score(x[i : i + 2048]) for i in range(0, len(x), 2048)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        in_holdout(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
