"""Spelling variants: words one letter apart, found in a trie of letter-group counts.

A word's path in the trie is how many of its letters belong to each of 16 letter groups, group after
group. One inserted, deleted or replaced letter changes the counts by a surplus of one, a deficit of
one, or one of each, so a depth-first search that may spend a deficit and then a surplus passes every
leaf that holds a near word; a pair is searched for from one side only. The words of such a leaf are
verified letter by letter.

Words in the order of their counts are the trie's leaves from left to right. That order is cut into
slices of about SLICE_WORDS words; a task holds the trie of one slice and lets the words that can reach
it stream through. The cuts come from a bounded sample of words and decide nothing but the sizes.

Defined results: a null text has no words; a null doc_id counts as the text "null"; repeated rows count
one by one; ties between forms go to the word first in code-point order; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.textstats import in_slices
from faultline.session import materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
LOWER = {c: c + 32 for c in range(65, 91)}
LEAST_LETTERS = 5
LEAST_COUNT = 3
FORM_FACTOR = 2
# Distinct words a task counts before it passes them on, and code points it looks at in one go.
WORDS_AT_ONCE = 200_000
TEXT_AT_ONCE = 1 << 20

LEVELS = 16
# Fixed value: letters by how common they are; the groups take them in turn.
COMMON = "etaoinshrdlcumwfgypbvkjxqz"
GROUP = np.array([COMMON.index(chr(c)) % LEVELS if chr(c) in COMMON else c % LEVELS for c in range(256)], dtype=np.int64)

SLICE_WORDS = 8192
MOST_SLICES = 4096
# Sampled words per slice that the cuts are taken from.
SAMPLE_PER_SLICE = 32
# Entries of the search, or pairs to verify, that are alive at a time.
ALIVE = 1 << 16
# Leaves of more words than this are looked up by their words with one letter out.
LARGE_LEAF = 512
# Longer words are compared one by one.
WIDEST = 64


# ---- counting


def runs(text: str, at_once: int = TEXT_AT_ONCE) -> Iterator[list[str]]:
    """All maximal runs of letters, in lists of those of about `at_once` code points."""
    start = 0
    while start < len(text):
        stop = start + at_once
        if stop < len(text):
            gap = NO_LETTER.search(text, stop)
            stop = gap.start() if gap else len(text)
        yield RUN.findall(text, start, stop)
        start = stop


def words_of(doc_id: int | None, text: str, drop_every: int | None) -> Iterator[tuple[str, int]]:
    """(word, times) of a text in lower case.

    With `drop_every`, a run loses one letter wherever the crc32 of id and run is divisible by it, which
    plants misspellings that are the same in every run of the job.
    """
    prefix = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
    for found in runs(text):
        for run, n in Counter(found).items():
            word = run if run.islower() else run.translate(LOWER)
            if drop_every:
                h = zlib.crc32(word.encode(), prefix)
                if h % drop_every == 0:
                    k = h % len(word)
                    word = word[:k] + word[k + 1 :]
            yield word, n


def word_counts(docs: DataFrame, drop_every: int | None = None) -> DataFrame:
    """word, n: the words of all texts with at least LEAST_LETTERS letters that occur LEAST_COUNT times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(counts: Counter) -> pa.RecordBatch:
            arrays = [pa.array(counts.keys(), type=pa.string()), pa.array(counts.values(), type=pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["word", "n"])

        counts: Counter = Counter()
        for batch in in_slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in words_of(doc_id, text or "", drop_every):
                    if len(word) >= LEAST_LETTERS:
                        counts[word] += n
                if len(counts) >= WORDS_AT_ONCE:
                    yield batch_of(counts)
                    counts.clear()
        yield batch_of(counts)

    held = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    counted = held.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# ---- the trie


def count_vectors(words: list[bytes]) -> np.ndarray:
    """Letters per group of each word; words are Latin-1 bytes, a letter each."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    row = np.repeat(np.arange(len(words)), lengths)
    place = row * LEVELS + GROUP[np.frombuffer(b"".join(words), dtype=np.uint8)]
    return np.bincount(place, minlength=len(words) * LEVELS).reshape(-1, LEVELS)


def path_keys(vectors: np.ndarray) -> np.ndarray:
    """Paths as byte strings that sort like the paths."""
    return np.ascontiguousarray(vectors.astype(">u4")).view(f"S{4 * LEVELS}").ravel()


class Letters:
    """Words as rows of letters, read from the front and from the back."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.front = np.array([w[:WIDEST] for w in words], dtype=f"S{WIDEST}").view(np.uint8).reshape(-1, WIDEST)
        self.back = np.array([w[: -WIDEST - 1 : -1] for w in words], dtype=f"S{WIDEST}").view(np.uint8).reshape(-1, WIDEST)


def differ_by_one(a: bytes, b: bytes) -> bool:
    """Exactly one letter inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    front = len(os.path.commonprefix([a, b]))
    back = len(os.path.commonprefix([a[::-1], b[::-1]]))
    return front + back >= max(len(a), len(b)) - 1


def near(left: Letters, a: np.ndarray, right: Letters, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a of `left`, b of `right`) differ by exactly one letter."""
    longest = np.maximum(left.length[a], right.length[b])
    width = int(min(longest.max(initial=1), WIDEST))

    def shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        other = one[a, :width] != two[b, :width]
        return np.where(other.any(axis=1), other.argmax(axis=1), width)

    front, back = shared(left.front, right.front), shared(left.back, right.back)
    # equal words share more than their length allows
    same = (left.length[a] == right.length[b]) & (front >= left.length[a])
    hit = (front + back >= longest - 1) & (np.abs(left.length[a] - right.length[b]) <= 1) & ~same
    for i in np.flatnonzero(longest > WIDEST).tolist():
        hit[i] = differ_by_one(left.words[a[i]], right.words[b[i]])
    return hit


class Trie:
    """Words by their counts, level after level; a node is a run of the sorted words, numbered from the left."""

    def __init__(self, words: list[bytes]) -> None:
        vectors = count_vectors(words)
        order = np.lexsort(vectors.T[::-1])
        vectors = vectors[order]
        self.letters = Letters([words[i] for i in order.tolist()])
        self.base = int(vectors.max(initial=0)) + 3
        self.levels: list[np.ndarray] = []  # children as parent * base + count, in order
        node = np.zeros(len(words), dtype=np.int64)
        for level in range(LEVELS):
            keys, node = np.unique(node * self.base + vectors[:, level], return_inverse=True)
            self.levels.append(keys)
        self.leaf = np.searchsorted(node, np.arange(node[-1] + 2 if len(node) else 1))
        self.out: dict[int, dict[bytes, list[int]]] = {}

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places that have the child, the children's numbers)."""
        keys = self.levels[level]
        key = node * self.base + np.minimum(count, self.base - 1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        has = np.flatnonzero((keys[at] == key) & (count >= 0))
        return has, at[has]

    def leaves(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, leaf, what was spent: 0 nothing, 1 the deficit, 2 both), depth first in pieces of bounded size."""
        stack = []
        for start in range(0, len(vectors), ALIVE):
            q = np.arange(start, min(start + ALIVE, len(vectors)))
            stack.append((0, q, np.zeros_like(q), np.zeros_like(q)))
        while stack:
            level, q, node, spent = stack.pop()
            if level == LEVELS:
                yield q, node, spent
                continue
            own = vectors[q, level]
            found = []
            for step, who in ((0, None), (-1, spent == 0), (1, spent == 1)):
                of = slice(None) if who is None else np.flatnonzero(who)
                has, child = self.child(level, node[of], own[of] + step)
                found.append((q[of][has], child, spent[of][has] + abs(step)))
            q, node, spent = (np.concatenate(parts) for parts in zip(*found, strict=True))
            for start in range(0, len(q), ALIVE):
                some = slice(start, start + ALIVE)
                stack.append((level + 1, q[some], node[some], spent[some]))

    def near_words(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, place) of near words, each pair from one side: from the longer word, or by the order of what is spent."""
        asked = Letters(words)
        for q, leaf, spent in self.leaves(count_vectors(words)):
            size = self.leaf[leaf + 1] - self.leaf[leaf]
            large = size > LARGE_LEAF
            if large.any():
                yield from self._in_large_leaves(words, q[large], leaf[large], spent[large])
                q, leaf, spent, size = q[~large], leaf[~large], spent[~large], size[~large]
            ends = np.cumsum(size)
            start = 0
            while start < len(q):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ALIVE, side="right")))
                n = size[start:stop]
                who = np.repeat(np.arange(start, stop), n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.leaf[leaf[start:stop]], n)
                hit = near(asked, q[who], self.letters, place)
                who, place = who[hit], place[hit]
                yield self._one_side(words, q[who], place, spent[who])
                start = stop

    def _one_side(
        self, words: list[bytes], q: np.ndarray, place: np.ndarray, spent: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Pairs inside a leaf meet twice; the lesser word keeps them."""
        mine = spent != 0
        for i in np.flatnonzero(~mine).tolist():
            mine[i] = words[q[i]] < self.letters.words[place[i]]
        return q[mine], place[mine]

    def _in_large_leaves(
        self, words: list[bytes], q: np.ndarray, leaf: np.ndarray, spent: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same by look-up: words of one length are near if they agree but for one place."""
        for i, number, used in zip(q.tolist(), leaf.tolist(), spent.tolist(), strict=True):
            if number not in self.out:
                table: dict[bytes, list[int]] = {}
                for place in range(self.leaf[number], self.leaf[number + 1]):
                    for form in {self.letters.words[place], *holes(self.letters.words[place])}:
                        table.setdefault(form, []).append(place)
                self.out[number] = table
            word, table = words[i], self.out[number]
            forms = {word[:k] + word[k + 1 :] for k in range(len(word))} if used == 1 else set(holes(word))
            places = sorted({p for form in forms for p in table.get(form, ()) if self.letters.words[p] != word})
            if places:
                places = np.array(places)
                yield self._one_side(words, np.full(len(places), i), places, np.full(len(places), used))


def holes(word: bytes) -> list[bytes]:
    """The word with each letter in turn replaced by a zero byte, which is no letter."""
    return [word[:k] + b"\0" + word[k + 1 :] for k in range(len(word))]


# ---- slices


def reachable(vectors: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slice) for every slice in which a search from the row's path can end, each once."""
    rows, slices = [], []

    def add(who: np.ndarray, paths: np.ndarray) -> None:
        rows.append(who)
        slices.append(np.searchsorted(cuts, path_keys(paths), side="right"))

    add(np.arange(len(vectors)), vectors)
    for j in range(LEVELS):
        who = np.flatnonzero(vectors[:, j] > 0)
        less = vectors[who]
        less[:, j] -= 1
        add(who, less)
        for i in range(j + 1, LEVELS):
            more = less.copy()
            more[:, i] += 1
            add(who, more)
    pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(slices)]), axis=1)
    return pairs[0], pairs[1]


def slice_cuts(words: DataFrame, slice_words: int) -> np.ndarray:
    """Paths at which the leaves are cut into slices, from at most MOST_SLICES * SAMPLE_PER_SLICE words."""
    slices = min(-(-words.count() // slice_words), MOST_SLICES)
    if slices <= 1:
        return path_keys(np.zeros((0, LEVELS), dtype=np.int64))
    sample = words.orderBy(F.xxhash64("word"), "word").limit(slices * SAMPLE_PER_SLICE).select("word").collect()
    keys = np.sort(path_keys(count_vectors([r["word"].encode("latin-1") for r in sample])))
    return np.unique(keys[np.arange(1, slices) * len(keys) // slices])


def near_pairs(words: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """word, near, near_n: every word with every word one letter apart, from a written table of word and n."""
    cuts = slice_cuts(words, slice_words)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 4096):
            vectors = count_vectors([w.encode("latin-1") for w in batch.column("word").to_pylist()])
            own = np.searchsorted(cuts, path_keys(vectors), side="right")
            row, to = reachable(vectors, cuts) if len(cuts) else (np.arange(len(vectors)), own)
            for side, which, where in ((0, np.arange(len(vectors)), own), (1, row, to)):
                sides = pa.array(np.full(len(which), side, dtype=np.int32))
                columns = [batch.column(c).take(pa.array(which)) for c in ("word", "n")]
                arrays = [pa.array(where.astype(np.int32)), sides, *columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["slice", "side", "word", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, trie, held, counts = None, None, [], []
        for batch in in_slices(batches, 8192):
            place = batch.column("slice").to_numpy() * 2 + batch.column("side").to_numpy()
            starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            for start, stop in itertools.pairwise([*starts.tolist(), len(place)]):
                number, side = divmod(int(place[start]), 2)
                some = batch.slice(start, stop - start)
                words = [w.encode("latin-1") for w in some.column("word").to_pylist()]
                if number != current:
                    current, trie, held, counts = number, None, [], []
                if side == 0:
                    held += words
                    counts += some.column("n").to_pylist()
                    continue
                if not held:
                    continue
                if trie is None:
                    trie, by_word = Trie(held), dict(zip(held, counts, strict=True))
                n = some.column("n").to_pylist()
                for q, at in trie.near_words(words):
                    pairs = [(words[i], n[i], trie.letters.words[p]) for i, p in zip(q.tolist(), at.tolist(), strict=True)]
                    rows = [(a, b, by_word[b]) for a, _, b in pairs] + [(b, a, m) for a, m, b in pairs]
                    if rows:
                        one, other, m = zip(*rows, strict=True)
                        texts = [pa.array([w.decode("latin-1") for w in column]) for column in (one, other)]
                        yield pa.RecordBatch.from_arrays([*texts, pa.array(m, type=pa.int64())], names=["word", "near", "near_n"])

    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        words.select("word", "n")
        .mapInArrow(deal, "slice int, side int, word string, n long")
        .repartition(partitions, "slice")
        .sortWithinPartitions("slice", "side")
        .mapInArrow(search, "word string, near string, near_n long")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root from (word, form): forms followed to the last, twice as far each round.

    A form has at least FORM_FACTOR times its word's count, so a chain is no longer than the log of the
    largest count, and rounds are the log of that.
    """
    current = materialise(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = current.toDF("via", "beyond")
        step = current.join(ahead, F.col("root") == F.col("via"), "left")
        step = step.select("word", F.coalesce("beyond", "root").alias("root"), F.col("via").isNotNull().alias("moved"))
        step = materialise(step, "variant-roots")
        current = step.select("word", "root")
        if not step.filter("moved").head(1):
            return current


def groups(docs: DataFrame, drop_every: int | None = None, slice_words: int = SLICE_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = materialise(word_counts(docs, drop_every), "variant-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = near_pairs(words, slice_words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    found = found.toDF("of", "n_near", "best")
    most = -F.col("best.less")
    has = most >= FORM_FACTOR * F.col("n")
    formed = words.join(found, F.col("word") == F.col("of"), "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best.near")).alias("form"),
        F.when(has, most).alias("form_n"),
    )
    formed = materialise(formed, "variant-forms")
    last = roots(formed.filter("form is not null")).toDF("of", "last")
    named = formed.join(last, F.col("word") == F.col("of"), "left")
    return named.select("word", "n", "n_near", "form", "form_n", F.coalesce("last", "word").alias("root"))
