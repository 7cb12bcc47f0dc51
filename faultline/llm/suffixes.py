"""Exact substring dedup: bytes covered by a string of `LENGTH` bytes that also starts earlier are removed.

All suffixes are compared to a depth of LENGTH bytes by bucket refinement:

1. Initial buckets. Of the q-grams in a string of LENGTH bytes the one with the least hash is its
   anchor; equal strings have equal anchors at equal places, so only suffixes with one anchor gram
   need comparing. Neighbouring strings share their anchor: one record stands for a stretch of them.
2. Equal stretches (one hash over all their bytes) are settled at once: the earliest stays, the
   others are covered. This is done in every batch before anything is shuffled, so a passage found
   in a third of all documents leaves a batch once. Buckets left with one stretch are finished.
3. The rest is refined on its bytes: buckets of 8 bytes are split by the bucket numbers found 8, 16,
   32, ... bytes further on, each round using the numbers of the one before, until LENGTH bytes are
   told apart. Suffixes alone in their bucket are left out of later rounds.

A hot anchor, that is one in very many different surroundings, never meets in one task. A batch that
holds many of its stretches deals them out by stretch and tells the anchor's own bucket that it is
hot; all its stretches are then compared string by string. Of equal strings a task sends on the
earliest only, once per window; these are refined per (string, salt), and what is left per string.

Equal stretches are told by two 64-bit hashes, of the anchor gram and of all bytes; two different
stretches of n agree in both with a chance below n * n / 2**129.

Order is (doc_id, start). Defined results: a null or empty text has no bytes and nothing removed; a
null doc_id comes after all others; rows equal in id and text (by its XXH64) are one document and get
the same row; rows of one id and different texts, those without an id included, are ordered by that
hash; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from faultline.session import materialise, shared_folder

LENGTH = 100
GRAM = 32
# Bytes that are hashed at once; a longer document is worked on in stretches.
BLOCK = 1 << 20
# Stretches of one gram beyond this are dealt out by string.
MOST_IN_BUCKET = 2000
# A gram with more stretches than this, and than a 64th of the rows, in one batch is hot.
MOST_IN_BATCH = 64
# Bytes of text whose stretches meet in one task; the number of tasks follows the table.
BUCKET_BYTES = 64 << 20
# Different strings of hot anchors a task holds before it sends them on, and the parts one string is dealt into.
WINDOW = 100_000
SALTS = 64
LAST_ID = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15
INDEX_BITS = 23
# What a packed row holds: stretches, ranges known to be covered, stretches of hot grams, hot grams.
PLAIN, COVERED, HOT, NOTICE = range(4)
SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("records", pa.binary())])
RECORD = np.dtype(
    [("gram", "<u8"), ("stretch", "<u8"), ("did", "<i8"), ("dig", "<i8"), ("lo", "<u4"), ("more", "u1")]
)


def _mix(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(BASE, -1, 1 << 64)
    both = []
    for factor in (BASE, inverse):
        steps = np.full(n, factor, dtype=np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def stretches(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: piece, first and last start, gram hash and hash of all their bytes."""
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    n = len(raw)
    ends = np.cumsum([len(p) for p in pieces])
    power, inverse = _powers(1 << max(n, BLOCK).bit_length())
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1], 0xBF58476D1CE4E5B9)
    low = np.uint64((1 << INDEX_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, done = LENGTH - GRAM + 1, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    # strings that stay inside their piece
    starts = np.arange(len(least))
    piece = np.searchsorted(ends, starts, side="right")
    valid = np.flatnonzero(starts + LENGTH <= ends[piece])
    anchor = (least[valid] & low).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    lo = valid[first]
    hi = valid[np.append(first[1:], len(valid)) - 1] if len(valid) else lo
    anchor = anchor[first]
    place = ((anchor - lo) * (2 * LENGTH) + (hi - lo)).astype(np.uint64)
    whole = _mix((sums[hi + LENGTH] - sums[lo]) * inverse[lo], 0x94D049BB133111EB)
    return piece[lo], lo, hi, grams[anchor], _mix(whole ^ (place * np.uint64(BASE)), 0xD6E8FEB86659FD93)


def records(texts: list[bytes], dids: np.ndarray, digs: np.ndarray) -> np.ndarray:
    """Records of all stretches of some documents."""
    out: list[np.ndarray] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if size >= LENGTH:
            pieces = [p for _, _, p in held]
            piece, lo, hi, gram, stretch = stretches(pieces)
            doc = np.array([d for d, _, _ in held])[piece]
            shift = np.array([at for _, at, _ in held]) - np.cumsum([0, *map(len, pieces[:-1])])
            rec = np.empty(len(lo), dtype=RECORD)
            rec["gram"], rec["stretch"], rec["did"], rec["dig"] = gram, stretch, dids[doc], digs[doc]
            rec["lo"], rec["more"] = lo + shift[piece], hi - lo
            out.append(rec)
        held.clear()
        size = 0

    for d, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for at in range(0, len(text) - LENGTH + 1, BLOCK):
            part = text[at : at + BLOCK + LENGTH - 1]
            if size + len(part) > 2 * BLOCK:
                flush()
            held.append((d, at, part))
            size += len(part)
    flush()
    return np.concatenate(out) if out else np.empty(0, dtype=RECORD)


def earliest(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the earliest record of each stretch, sorted by gram; the records of later places)."""
    order = np.lexsort((rec["lo"], rec["dig"], rec["did"], rec["stretch"], rec["gram"]))
    rec = rec[order]
    new = np.ones(len(rec), dtype=bool)
    new[1:] = (rec["gram"][1:] != rec["gram"][:-1]) | (rec["stretch"][1:] != rec["stretch"][:-1])
    starts = np.flatnonzero(new)
    leader = rec[np.repeat(starts, np.diff(np.append(starts, len(rec))))]
    later = (rec["did"] != leader["did"]) | (rec["dig"] != leader["dig"]) | (rec["lo"] != leader["lo"])
    return rec[starts], rec[later]


def marked_runs(did: np.ndarray, dig: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching byte ranges of each document as one."""
    order = np.lexsort((lo, dig, did))
    did, dig, lo, end = did[order], dig[order], lo[order], end[order]
    doc = np.zeros(len(did), dtype=np.int64)
    doc[1:] = np.cumsum((did[1:] != did[:-1]) | (dig[1:] != dig[:-1]))
    # a document's ranges all lie past those of the one before it
    shift = doc * (int(end.max(initial=0)) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(did), dtype=bool)
    new[1:] = (lo + shift)[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(did)) - 1
    return did[starts], dig[starts], lo[starts], (reach[last] - shift[last]) if len(did) else end


FOUND = "request boolean, split boolean, gram long, did long, dig long, lo long, end long"


def _found(request: bool, split: np.ndarray, gram: np.ndarray, did, dig, lo, end) -> pa.RecordBatch:
    n = len(did)
    columns = [np.full(n, request), split, gram.view(np.int64), did, dig, lo, end]
    kinds = [pa.bool_(), pa.bool_(), *[pa.int64()] * 5]
    arrays = [pa.array(np.asarray(c), type=k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[part.split()[0] for part in FOUND.split(", ")])


def _marks(did, dig, lo, end) -> pa.RecordBatch:
    did, dig, lo, end = marked_runs(did, dig.astype(np.int64), lo.astype(np.int64), end.astype(np.int64))
    return _found(False, np.zeros(len(did), dtype=bool), np.zeros(len(did), dtype=np.uint64), did, dig, lo, end)


def _reach(rec: np.ndarray) -> np.ndarray:
    return rec["lo"].astype(np.int64) + rec["more"] + LENGTH


def per_gram(rec: np.ndarray) -> np.ndarray:
    """How many records sorted by gram share each one's gram."""
    starts = np.flatnonzero(np.append(True, rec["gram"][1:] != rec["gram"][:-1])[: len(rec)])
    sizes = np.diff(np.append(starts, len(rec)))
    return np.repeat(sizes, sizes)


def first_pass(texts: DataFrame, buckets: int, most: int, most_in_batch: int) -> DataFrame:
    """Ranges known to be covered, and the stretches whose bytes must be looked at (requests)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            dids, digs = (batch.column(c).to_numpy() for c in ("did", "dig"))
            kept, later = earliest(records(raw, dids, digs))
            del raw
            hot = per_gram(kept) > max(most_in_batch, batch.num_rows // 64)
            notices = np.unique(kept["gram"][hot])
            names: list[int] = []
            kinds: list[int] = []
            blobs: list[bytes] = []
            # one row of packed records for each partition they go to
            for kind, what, by in (
                (PLAIN, kept[~hot], kept["gram"][~hot]),
                (HOT, kept[hot], kept["stretch"][hot]),
                (NOTICE, notices, notices),
            ):
                bucket = (by % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                what, cuts = what[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
                found = np.flatnonzero(np.diff(cuts)).tolist()
                names += found
                kinds += [kind] * len(found)
                blobs += [what[cuts[b] : cuts[b + 1]].tobytes() for b in found]
            if len(later):
                names.append(number % buckets)
                kinds.append(COVERED)
                blobs.append(later.tobytes())
            arrays = [pa.array(names, type=pa.int32()), pa.array(kinds, type=pa.int32()), pa.array(blobs, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=SENT)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {PLAIN: [], HOT: [], NOTICE: []}
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("records").to_pylist(), strict=True):
                if kind == COVERED:
                    rec = np.frombuffer(blob, dtype=RECORD)
                    yield _marks(rec["did"], rec["dig"], rec["lo"], _reach(rec))
                else:
                    blobs[kind].append(blob)
        notices = np.unique(np.frombuffer(b"".join(blobs[NOTICE]), dtype=np.uint64))
        for kind in (PLAIN, HOT):
            rec = np.frombuffer(b"".join(blobs.pop(kind)), dtype=RECORD)
            kept, later = earliest(rec)
            if len(later):
                yield _marks(later["did"], later["dig"], later["lo"], _reach(later))
            each = per_gram(kept)
            split = np.ones(len(kept), dtype=bool) if kind == HOT else (each > most) | np.isin(kept["gram"], notices)
            wanted = split | (each > 1)
            asked = kept[wanted]
            if len(asked):
                yield _found(True, split[wanted], asked["gram"].copy(), asked["did"], asked["dig"], asked["lo"], _reach(asked))

    sent = texts.select("did", "dig", "text").mapInArrow(send, "bucket int, kind int, records binary")
    return sent.repartitionById(buckets, "bucket").mapInArrow(settle, FOUND)


def buckets_at_depth(raw: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """A number for each of `starts`, equal where the next `depth` bytes are equal; each has that many bytes.

    Numbers of 8 bytes come from the bytes themselves. Then a bucket is split by the numbers found
    `done` bytes on; as the last step need not be a whole doubling, it may overlap the one before.
    """
    n = len(raw)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = raw
    eight = np.lib.stride_tricks.as_strided(padded, shape=(n, 8), strides=(1, 1)).copy().view("<u8")[:, 0]
    words, number = np.unique(eight, return_inverse=True)
    number = number.astype(np.int64)
    base, done = len(words), 8
    open_ = np.arange(n)
    while done < depth:
        step = min(done, depth - done)
        # places alone in their bucket keep their number and are looked at no more
        counts = np.bincount(number[open_], minlength=base)
        open_ = open_[(counts[number[open_]] > 1) & (open_ + step < n)]
        _, fresh = np.unique(number[open_] * base + number[open_ + step], return_inverse=True)
        changed = number.copy()
        changed[open_] = base + fresh
        base += len(open_)
        number = changed
        done += step
    return number[starts]


PIECES = "bucket long, salt int, did long, dig long, lo long, end long, piece binary"
PIECE = pa.schema(
    [(name, pa.binary() if kind == "binary" else pa.int32() if kind == "int" else pa.int64())
     for name, kind in (part.split() for part in PIECES.split(", "))]
)


def _ranges(did, dig, lo, end) -> pa.RecordBatch:
    """Covered ranges as rows without a piece."""
    did, dig, lo, end = marked_runs(did, dig, lo, end)
    n = len(did)
    columns = [did, np.full(n, -1), did, dig, lo, end, [None] * n]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, PIECE, strict=True)], schema=PIECE)


def _strings(found: dict[bytes, tuple[int, int, int]]) -> pa.RecordBatch:
    """Pieces of one string each."""
    places = np.array(list(found.values()), dtype=np.int64).reshape(-1, 3)
    did, dig, lo = places.T
    bucket = [xxhash.xxh64_intdigest(string) >> 1 for string in found]
    columns = [bucket, (dig & (SALTS - 1)).astype(np.int32), did, dig, lo, lo + LENGTH, list(found)]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, PIECE, strict=True)], schema=PIECE)


def _compared(batches: Iterator[pa.RecordBatch], keys: list[str], keep: bool) -> Iterator[pa.RecordBatch]:
    """Covered ranges among pieces sorted by `keys`, and, if `keep`, the earliest of each string; ranges pass."""
    from faultline.llm.simhash import whole_runs

    for run in whole_runs(batches, keys):
        passed = run.filter(pc.is_null(run.column("piece")))
        yield from passed.to_batches()
        rows = run.filter(pc.is_valid(run.column("piece")))
        if not rows.num_rows:
            continue
        did, dig, lo = (rows.column(c).to_numpy() for c in ("did", "dig", "lo"))
        pieces = rows.column("piece").to_pylist()
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        strings = sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(pieces)), strings)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
        number = buckets_at_depth(raw, (np.cumsum(sizes) - sizes)[owner] + within)
        at = lo[owner] + within
        order = np.lexsort((at, dig[owner], did[owner], number))
        number, owner, at = number[order], owner[order], at[order]
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1])[: len(number)])
        leader = np.repeat(starts, np.diff(np.append(starts, len(number))))
        later = (did[owner] != did[owner[leader]]) | (dig[owner] != dig[owner[leader]]) | (at != at[leader])
        if keep:  # pieces are one string each
            yield from rows.take(pa.array(owner[starts])).to_batches()
        if later.any():
            owner, at = owner[later], at[later]
            yield _ranges(did[owner], dig[owner], at, at + LENGTH)


def second_pass(texts: DataFrame, requests: DataFrame) -> DataFrame:
    """Covered ranges (did, dig, lo, end) of the stretches asked for, from their bytes."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def of(split: bool) -> DataFrame:
        # at most one entry per anchor of a document, in an order that a rerun keeps
        entries = F.sort_array(F.collect_list(F.struct("gram", "lo", "end"))).alias("asked")
        asked = requests.filter(F.col("split") == split).groupBy("did", "dig").agg(entries)
        return texts.join(asked, ["did", "dig"]).select("did", "dig", "text", "asked")

    def compared(pieces: DataFrame, keys: list[str], keep: bool) -> DataFrame:
        dealt = pieces.repartition(partitions, *keys).sortWithinPartitions(*keys)
        return dealt.mapInArrow(lambda batches: _compared(batches, keys, keep), PIECES)

    whole = compared(of(False).mapInArrow(_whole_pieces, PIECES), ["bucket"], False)
    earliest_of_part = compared(of(True).mapInArrow(_split_pieces, PIECES), ["bucket", "salt"], True)
    split = compared(earliest_of_part, ["bucket"], False)
    return whole.unionByName(split).select("did", "dig", "lo", "end")


def _whole_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch asked for once, under its gram."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            out: dict[tuple, bytes] = {}
            for did, dig, text, asked in _documents(batch.slice(i, 64)):
                raw = text.encode("utf-8", "surrogatepass")
                for a in asked:
                    out[a["gram"], -1, did, dig, a["lo"], a["end"]] = raw[a["lo"] : a["end"]]
            columns = [*zip(*out, strict=True), list(out.values())] if out else [()] * 7
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, PIECE, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=PIECE)


def _split_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The earliest place of each string within a window, and the later places as covered ranges."""
    found: dict[bytes, tuple[int, int, int]] = {}
    later: list[tuple[int, int, int]] = []
    for batch in batches:
        for did, dig, text, asked in _documents(batch):
            raw = text.encode("utf-8", "surrogatepass")
            for a in asked:
                for at in range(a["lo"], a["end"] - LENGTH + 1):
                    string, place = raw[at : at + LENGTH], (did, dig, at)
                    first = found.setdefault(string, place)
                    if place < first:
                        found[string] = place
                        later.append(first)
                    elif place > first:
                        later.append(place)
                if len(found) + len(later) >= WINDOW:
                    yield from _sent_on(found, later)
                    found, later = {}, []
    yield from _sent_on(found, later)


def _sent_on(found: dict[bytes, tuple[int, int, int]], later: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    if found:
        yield _strings(found)
    if later:
        did, dig, at = np.array(later, dtype=np.int64).T
        yield _ranges(did, dig, at, at + LENGTH)


def _documents(batch: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        yield tuple(batch.column(c)[i].as_py() for c in ("did", "dig", "text", "asked"))


def runs_of(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal covered runs, in order."""
    runs: list[list[int]] = []
    for lo, end in sorted((r["lo"], r["end"]) for r in ranges or ()):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([lo, end])
    return [(a, b) for a, b in runs]


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]


def covered(docs: DataFrame, most: int = MOST_IN_BUCKET, most_in_batch: int = MOST_IN_BATCH) -> DataFrame:
    """doc_id, text and the covered byte `ranges` (unordered, may overlap) of every row.

    The texts are written once, in buckets by document, so that they are joined without being
    shuffled; what is joined to them is a list of ranges per document.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"substring_texts_{uuid.uuid4().hex[:12]}"
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("did"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("dig", F.xxhash64("text"))
    written = Observation(name)
    counted = keyed.observe(written, F.sum(F.octet_length("text")).alias("bytes"))
    path = shared_folder(spark, "substring-texts")
    counted.write.bucketBy(partitions, "did", "dig").option("path", path).saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"drop table {name}")  # the catalogue keeps no entry; the files stay
    buckets = max(partitions, -(-(written.get["bytes"] or 0) // BUCKET_BYTES))
    found = materialise(first_pass(texts, buckets, most, most_in_batch), "substring-first")
    more = materialise(second_pass(texts, found.filter("request")), "substring-second")
    known = found.filter("not request").select("did", "dig", "lo", "end").unionByName(more)
    ranges = known.groupBy("did", "dig").agg(F.collect_list(F.struct("lo", "end")).alias("ranges"))
    return texts.join(ranges, ["did", "dig"], "left").select("doc_id", "text", "ranges")


def dedup(docs: DataFrame, most: int = MOST_IN_BUCKET, most_in_batch: int = MOST_IN_BATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                digest, at, removed = hashlib.sha256(), 0, 0
                runs = runs_of(ranges)
                for a, b in runs:
                    digest.update(raw[at:a])
                    at, removed = b, removed + b - a
                digest.update(raw[at:])
                rows.append((len(raw), removed, len(runs), digest.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=FIELDS)

    return covered(docs, most, most_in_batch).mapInArrow(run, SCHEMA)
