"""Near-duplicates by 64-bit SimHash, compared bit-sliced.

Distinct fingerprints are put into buckets that share two of six bit blocks: of fingerprints at most
four bits apart, at least two blocks are equal, so each link meets in some bucket. Inside a bucket
the fingerprints lie as vertical bit planes, 64 to a machine word. Differing planes are summed by
carry-save counters for 64 pairs at once, and words in which every pair is beyond the radius are
left out as soon as that is known. A bucket passes on a spanning forest of its links, never all pairs.

Defined results: a null text is an empty one; texts without words have fingerprint 0 and are linked
like any other; a null doc_id never names a component while another id is there; repeated rows
get the same component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.textstats import in_slices
from faultline.session import materialise

SEED = 42
SHINGLE = 4
RADIUS = 4
BITS = 64
# Bit blocks as (first bit, bits); two of them equal make a key of 20 to 22 bits.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
# Fingerprints of one key beyond this are dealt into chunks, compared two chunks at a time.
MOST_IN_BUCKET = 4096
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE, bits_at_once: int = 1 << 16) -> int:
    """SimHash of a whole text over its word shingles, repeats included."""
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), bits_at_once):
        some = np.array(hashes[at : at + bits_at_once], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and digest (of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = [signed(fingerprint(text)) for text in batch.column("text").to_pylist()]
            arrays = [batch.column("doc_id"), pa.array(found, type=pa.int64()), batch.column("digest")]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "fp", "digest"])

    columns = ("cast(doc_id as long) doc_id", "cast(text as string) text")
    held = docs.selectExpr(*columns).withColumn("digest", F.xxhash64("text"))
    return held.mapInArrow(run, "doc_id long, fp long, digest long")


# ---- bit-sliced comparison


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of fingerprints: word w of plane b holds bit b of fingerprints 64w to 64w+63."""
    padded = np.zeros(-(-len(fps) // 64) * 64, dtype=np.uint64)
    padded[: len(fps)] = fps
    rows = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(rows.T.copy(), axis=1, bitorder="little").view(np.uint64)


def lanes(words: np.ndarray) -> np.ndarray:
    """Numbers of the set lanes of a row of words."""
    return np.flatnonzero(np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little"))


def within(planes: np.ndarray, others: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Words whose set lanes are at most `radius` (up to 6) bits apart; `others` is any shape that broadcasts to one word row per plane.

    Three carry-save counters per lane count to seven and a sticky bit keeps what is over. After
    every eighth plane only words with a lane still inside go on.
    """
    shape = np.broadcast_shapes(planes.shape, others.shape)[1:]
    planes, others = np.broadcast_to(planes, (BITS, *shape)), np.broadcast_to(others, (BITS, *shape))
    planes, others = planes.reshape(BITS, -1), others.reshape(BITS, -1)
    result = np.zeros(planes.shape[1], dtype=np.uint64)
    alive = np.arange(planes.shape[1])
    one, two, four, over = (np.zeros(len(alive), dtype=np.uint64) for _ in range(4))
    for first in range(0, BITS, 8):
        left, right = planes[first : first + 8, alive], others[first : first + 8, alive]
        for x in left ^ right:
            carry = one & x
            one = one ^ x
            high = two & carry
            two = two ^ carry
            over = over | (four & high)
            four = four ^ high
        # counters above the radius: none comes back
        over = over | above(one, two, four, radius)
        keep = np.flatnonzero(over != ONES)
        if len(keep) < len(alive):
            alive, one, two, four, over = alive[keep], one[keep], two[keep], four[keep], over[keep]
        if not len(alive):
            return result.reshape(shape)
    result[alive] = ~over
    return result.reshape(shape)


def above(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is over `radius`."""
    more = np.zeros_like(one)
    same = np.full_like(one, ONES)
    for counter, bit in ((four, radius >> 2 & 1), (two, radius >> 1 & 1), (one, radius & 1)):
        if bit:
            same = same & counter
        else:
            more = more | (same & counter)
            same = same & ~counter
    return more


def shifted(planes: np.ndarray, by: int) -> np.ndarray:
    """Planes in which each lane holds the fingerprint `by` lanes further on."""
    whole, part = divmod(by, 64)
    out = np.zeros_like(planes)
    words = planes.shape[1] - whole
    out[:, :words] = planes[:, whole:] >> np.uint64(part)
    if part:
        out[:, : words - 1] |= planes[:, whole + 1 :] << np.uint64(64 - part)
    return out


def links_in_runs(fps: np.ndarray, runs: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places) within the radius inside runs of equal key; `runs` are the run lengths.

    All fingerprints are compared with the ones 1, 2, 3, ... places on at once. At each step only
    the runs long enough for it are still there.
    """
    size = np.repeat(runs, runs)
    left = np.repeat(np.cumsum(runs), runs) - np.arange(len(fps))  # places to the run's end
    place = np.flatnonzero(size > 1)
    step = 1
    while len(place):
        planes = planes_of(fps[place])
        # how far this layout serves: until half of it is out of use
        until = max(step + 1, int(np.median(size[place])))
        for by in range(step, until):
            inside = np.packbits(left[place] > by, bitorder="little")
            mask = np.zeros(planes.shape[1] * 8, dtype=np.uint8)
            mask[: len(inside)] = inside
            mask = mask.view(np.uint64)
            if mask.any():
                used = np.flatnonzero(mask)
                hits = np.zeros(planes.shape[1], dtype=np.uint64)
                hits[used] = within(planes[:, used], shifted(planes, by)[:, used], radius) & mask[used]
                found = lanes(hits)
                if len(found):
                    yield place[found], place[found + by]
        step = until
        place = place[size[place] > step]


def links_between(
    fps: np.ndarray, others: np.ndarray, radius: int = RADIUS, at_once: int = 64
) -> Iterator[tuple[int, np.ndarray]]:
    """(place, places within the radius) between two chunks, `at_once` fingerprints against a whole chunk."""
    planes = planes_of(others)[:, None, :]
    spare = np.packbits(np.arange(planes.shape[2] * 64) < len(others), bitorder="little").view(np.uint64)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for at in range(0, len(fps), at_once):
        own = np.where(bits[at : at + at_once].T[:, :, None] == 1, ONES, np.uint64(0))
        hits = within(planes, own, radius) & spare
        for row in np.flatnonzero(hits.any(axis=1)).tolist():
            yield at + row, lanes(hits[row])


def forest_between(fps: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spanning links between the places `one` and `two`; trees are numbers, merged a row of hits at a time."""
    tree = np.arange(len(fps))
    for row, found in links_between(fps[one], fps[two]):
        a = int(one[row])
        numbers, at = np.unique(tree[two[found]], return_index=True)
        fresh = numbers != tree[a]
        if fresh.any():
            yield from ((a, int(two[found[i]])) for i in at[fresh])
            tree[np.isin(tree, numbers)] = tree[a]


class Forest:
    """Union-find over the places of one batch; keeps the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.kept: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, left: Iterable[int], right: Iterable[int]) -> None:
        for a, b in zip(left, right, strict=True):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.kept.append((a, b))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches of rows sorted by `keys`, cut so that rows of equal keys stay together."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and any(c[0] != v for c, v in zip(columns, last, strict=True))
        cuts = np.flatnonzero(change)
        last = [c[-1] for c in columns]
        if len(cuts):
            rest.append(batch.slice(0, int(cuts[-1])))
            yield pa.Table.from_batches(rest)
            rest = [batch.slice(int(cuts[-1]))]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def forest_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of every bucket of rows sorted by (bucket, cell); `side` tells two chunks apart."""
    for rows in whole_runs(batches, ["bucket", "cell"]):
        fps = rows.column("fp").to_numpy().view(np.uint64)
        bucket, cell, side = (rows.column(c).to_numpy() for c in ("bucket", "cell", "side"))
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])])
        runs = np.diff(np.r_[starts, len(fps)])
        forest = Forest(len(fps))
        split = cell[starts] >= 0
        large = split | (runs > 128)
        small = np.flatnonzero(np.repeat(~large, runs))
        for a, b in links_in_runs(fps[small], runs[~large]):
            forest.add(small[a].tolist(), small[b].tolist())
        for start, n in zip(starts[large].tolist(), runs[large].tolist(), strict=True):
            of = side[start : start + n]
            for a, b in forest_between(fps[start : start + n], np.flatnonzero(of <= 0), np.flatnonzero(of != 0)):
                forest.add([start + a], [start + b])
        if forest.kept:
            a, b = np.array(forest.kept).T
            signed_fps = fps.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed_fps[a]), pa.array(signed_fps[b])], names=["a", "b"])


def links(distinct: DataFrame, most: int = MOST_IN_BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all that lie within the radius."""
    keys = []
    for number, (x, y) in enumerate(itertools.combinations(BLOCKS, 2)):
        block = [F.shiftrightunsigned(F.col("fp"), at).bitwiseAND((1 << bits) - 1) for at, bits in (x, y)]
        keys.append((F.shiftleft(block[0], y[1]) + block[1]) * F.lit(16) + F.lit(number))
    entries = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    full = (
        entries.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        .select(F.col("bucket").alias("full"), F.ceil(F.col("n") / most).cast("int").alias("chunks"))
    )
    full = materialise(full, "full-buckets")
    joined = entries.join(full, F.col("bucket") == F.col("full"), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # A cell is a pair of chunks. Side 0 is the lower chunk, 1 the higher, -1 a chunk with itself.
    cells = (
        joined.filter(F.col("chunks").isNotNull())
        .select("fp", "bucket", "chunks", own.alias("own"), other.alias("other"))
        .select(
            "fp",
            "bucket",
            (low * F.col("chunks") + high).cast("int").alias("cell"),
            F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )
    plain = joined.filter(F.col("chunks").isNull()).select(
        "fp", "bucket", F.lit(-1).alias("cell"), F.lit(-1).alias("side")
    )
    dealt = plain.unionByName(cells)
    partitions = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(partitions, "bucket", "cell")
        .sortWithinPartitions("bucket", "cell")
        .mapInArrow(forest_of_buckets, "a long, b long")
        .distinct()
    )


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, label): the least `rank` reachable, by alternating star contractions over written tables.

    `nodes` has fp and rank, edges a and b. Each round every node points at the least rank among
    its neighbours and itself; rounds end when nothing changes, about the log of the longest path.
    The least of each node is written before it is joined, so a node with very many neighbours is a
    skewed key of a plain join, which AQE splits over tasks.
    """
    ranked = nodes.select("fp", "rank")
    named = (
        edges.join(ranked.toDF("a", "u"), "a").join(ranked.toDF("b", "v"), "b")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    )
    current = materialise(named, "simhash-edges")
    mark = _mark(current)
    while True:
        # large star: neighbours above a node point at the least node around it
        both = current.union(current.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        pointed = point_at(both.filter(F.col("v") > F.col("u")), materialise(least, "large-least"))
        large = materialise(pointed.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # small star: neighbours below a node, and the node, point at the least of them
        below = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "small-least")
        small = point_at(large, below).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        after = materialise(small.union(below.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, mark = mark, _mark(after)
        if mark == before:
            break
        current = after
    return after


def point_at(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The edges of each node with the node `m` that its neighbours are to point at."""
    return edges.join(least, "u")


def _mark(edges: DataFrame):
    """Count and order-free hash of a set of edges: equal when a round changed nothing."""
    return edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
    ).first()


def classes(docs: DataFrame, most: int = MOST_IN_BUCKET) -> DataFrame:
    """doc_id, fp, digest, component_id (least doc_id reachable) and component (its node) of every row."""
    rows = materialise(fingerprints(docs), "simhash-rows")
    # Equal fingerprints are one node, so a text copied into a third of all rows is one node.
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    edges = materialise(links(nodes.select("fp"), most), "simhash-links")
    # Nodes are ranked by their least id; without an id a node comes last, by fingerprint.
    rank = F.struct(F.col("least").isNull().alias("unnamed"), F.coalesce("least", "fp").alias("id"), "fp")
    star = components(edges, nodes.select("fp", rank.alias("rank")))
    named = nodes.select("fp", rank.alias("rank")).join(star.toDF("rank", "top"), "rank", "left")
    top = F.coalesce("top", "rank")
    labels = named.select("fp", F.when(~top["unnamed"], top["id"]).alias("component_id"), top["fp"].alias("component"))
    return rows.join(labels, "fp").select("doc_id", "fp", "digest", "component_id", "component")


def one_of_each(docs: DataFrame, most: int = MOST_IN_BUCKET) -> DataFrame:
    """The rows of `docs` with the least id of their component; of rows equal in id and text, one.

    That one is the first by source. Columns of any name pass through.
    """
    columns = docs.columns
    names = [f"_in{i}" for i in range(len(columns))]
    place = dict(zip(columns, names, strict=True))
    held = docs.toDF(*names)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first")
    members = classes(docs, most).select("doc_id", "digest", "component")
    # Equal rows are counted before anything is joined.
    members = materialise(members.groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n")), "simhash-members")
    firsts = members.groupBy("component").agg(first).select("component", "first.doc_id", "first.digest")
    keepers = members.alias("m").join(
        firsts.alias("f"),
        (F.col("m.component") == F.col("f.component"))
        & F.col("m.doc_id").eqNullSafe(F.col("f.doc_id"))
        & (F.col("m.digest") == F.col("f.digest")),
    )
    keepers = materialise(keepers.select("m.doc_id", "m.digest", "n").toDF("kept_id", "kept_digest", "n"), "simhash-kept")
    doc_id, text = F.col(place["doc_id"]).cast("long"), F.col(place["text"]).cast("string")
    keyed = held.withColumn("digest", F.xxhash64(text))
    left = keyed.join(keepers, doc_id.eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")))
    single = left.filter("n = 1").select(*names)
    # Partial aggregation leaves one row per task of however many equal ones.
    comparable = [n for n, f in zip(names, held.schema.fields, strict=True) if "map<" not in f.dataType.simpleString()]
    order = F.struct(F.col(place["source"]).cast("string"), *comparable) if "source" in place else F.struct(*comparable)
    best = F.min_by(F.struct(*names), order).alias("row")
    repeated = left.filter("n > 1").groupBy("kept_id", "kept_digest").agg(best)
    return single.unionByName(repeated.select(*[F.col(f"row.{n}").alias(n) for n in names])).toDF(*columns)
