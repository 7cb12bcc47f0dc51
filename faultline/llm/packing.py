"""Packing by multiway differencing: near-equal windows of at most `capacity` tokens.

Every Arrow batch of documents is one block: its documents are tokenised, cut into pieces, and the
pieces shared out over windows. Nothing is shuffled and a task holds one batch at a time.

Defined results: a null or empty text is the single closing id; repeated rows are documents of
their own; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 1024
# Longest item of a remainder: more and smaller items let the windows come out even.
LONGEST_ITEM = 256
# Items per differencing block; a partial partition is a vector over the block's windows.
BLOCK_ITEMS = 512
CLOSING_ID = 0

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long"
)
FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each item by Karmarkar-Karp differencing.

    Each item starts as a partial partition (itself, nothing, ...). The two partitions of the
    widest spread are merged, the fullest windows of one onto the emptiest of the other, until one
    partition is left. Ties go to the partition made first.
    """
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    # A partition is (sums in descending order, node of each window); node -1 is an empty window.
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(windows, dtype=np.int64)
        nodes = np.full(windows, -1, dtype=np.int64)
        sums[0], nodes[0] = size, i
        parts.append((sums, nodes))
        heap.append((-size, i))
    heapq.heapify(heap)
    merges = []
    next_node = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        (sums_a, nodes_a), (sums_b, nodes_b) = parts[a], parts[b]
        parts[a] = parts[b] = None  # type: ignore[call-overload]
        left, right = nodes_a, nodes_b[::-1]
        sums = sums_a + sums_b[::-1]
        nodes = np.where(left < 0, right, left)
        both = np.flatnonzero((left >= 0) & (right >= 0))
        if len(both):
            fresh = np.arange(next_node, next_node + len(both))
            next_node += len(both)
            merges.append((fresh, left[both], right[both]))
            nodes[both] = fresh
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        parts.append((sums, nodes))
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), len(parts) - 1))
    window = np.zeros(next_node, dtype=np.int64)
    sums, nodes = parts[heap[0][1]]
    used = np.flatnonzero(nodes >= 0)
    window[nodes[used]] = used
    for fresh, left, right in reversed(merges):
        window[left] = window[fresh]
        window[right] = window[fresh]
    return window[:n]


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item, no window above `capacity`; the window count rises until that holds.

    With one window for each item the largest sum is the largest item, so the search ends.
    """
    if len(sizes) == 0:
        return np.zeros(0, dtype=np.int64)
    if sizes.max() > capacity:
        raise ValueError("an item is larger than a window")
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, count)
        sums = np.bincount(window, weights=sizes, minlength=count)
        if sums.max() <= capacity:
            return window
        over = float(np.maximum(sums - capacity, 0).sum())
        count = min(len(sizes), count + max(1, int(over / capacity / 2)))


def cut(tokens: int, capacity: int, longest: int) -> list[int]:
    """Lengths a document is cut into: full windows first, then a remainder of items up to `longest`."""
    pieces = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    if rest > longest:
        parts = -(-rest // longest)
        pieces += [rest // parts + (i < rest % parts) for i in range(parts)]
    elif rest:
        pieces.append(rest)
    return pieces


def plan(lengths: np.ndarray, capacity: int, longest: int, block: int) -> dict[str, np.ndarray]:
    """Pieces of documents with the given token counts: document, start, length, sequence and offset."""
    document, start, length = [], [], []
    for d, tokens in enumerate(lengths.tolist()):
        at = 0
        for size in cut(tokens, capacity, longest):
            document.append(d)
            start.append(at)
            length.append(size)
            at += size
    document, start, length = (np.array(x, dtype=np.int64) for x in (document, start, length))
    sequence = np.zeros(len(length), dtype=np.int64)
    full = np.flatnonzero(length == capacity)
    sequence[full] = np.arange(len(full))
    items = np.flatnonzero(length < capacity)
    first = len(full)
    for lo in range(0, len(items), block):
        chosen = items[lo : lo + block]
        # windows that got nothing leave no gap
        _, window = np.unique(windows_of(length[chosen], capacity), return_inverse=True)
        sequence[chosen] = first + window
        first += int(window.max()) + 1
    order = np.lexsort((start, document, sequence))
    ends = np.cumsum(length[order])
    opens = np.flatnonzero(np.diff(sequence[order], prepend=-1))
    before = ends - length[order]
    totals = np.diff(np.append(before[opens], ends[-1] if len(ends) else 0))
    runs = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(order))))
    offset = np.empty(len(length), dtype=np.int64)
    total = np.empty(len(length), dtype=np.int64)
    offset[order] = before - before[opens][runs]
    total[order] = totals[runs]
    return {
        "document": document, "start": start, "length": length, "sequence": sequence, "offset": offset, "total": total,
    }


@functools.cache
def _encoders(json_path: str, ranks_path: str, pattern: str):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    plain = Tokenizer.from_file(json_path)
    special = {token.content: i for i, token in plain.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return plain, fast


def encoder(json_path: str, ranks_path: str, pattern: str):
    """Text to ids as the `tokenizers` file gives them.

    The ranks file holds the same vocabulary and merges; it is about five times as fast. A text its
    pattern engine gives up on (runs of white space without end) goes through the other library.
    """
    plain, fast = _encoders(json_path, ranks_path, pattern)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as error:  # a panic of the library is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def decoder(json_path: str, ranks_path: str, pattern: str):
    """Ids to the text they stand for."""
    _, fast = _encoders(json_path, ranks_path, pattern)

    def decode(ids: np.ndarray) -> str:
        return fast.decode_bytes(ids.tolist()).decode()

    return decode


def tokenizer_files() -> tuple[str, str, str]:
    """(tokenizer file, its ranks, its pattern) of the public byte-level vocabulary; every node has them."""
    import public_tokenizers

    return (
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def pack(
    docs: DataFrame,
    tokenizer: tuple[str, str, str] | None = None,
    capacity: int = CAPACITY,
    longest_item: int = LONGEST_ITEM,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """One row per piece of a document: where it starts there, and its place in a sequence.

    A document is the ids of its text and the closing id 0. Full windows are sequences of their
    own; what is left of each document goes through differencing. `sequence_id` holds the task's
    partition in its upper bits, so tasks need no agreement; a task run anew gives the same ids.
    """
    files = tokenizer or tokenizer_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        next_sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            closing = np.array([CLOSING_ID], dtype=np.uint32)
            ids = [
                np.concatenate((encode(text), closing)) if text else closing
                for text in batch.column("text").to_pylist()
            ]
            if not ids:
                continue
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            pieces = plan(lengths, capacity, longest_item, block_items)
            crc = [
                zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes())
                for d, s, n in zip(
                    pieces["document"].tolist(), pieces["start"].tolist(), pieces["length"].tolist(), strict=True
                )
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(pieces["document"])),
                    pa.array(pieces["start"]),
                    pa.array(pieces["length"]),
                    pa.array(crc, type=pa.int64()),
                    pa.array(lengths[pieces["document"]]),
                    pa.array(pieces["sequence"] + next_sequence),
                    pa.array(pieces["offset"]),
                    pa.array(pieces["total"]),
                ],
                names=FIELDS,
            )
            next_sequence += int(pieces["sequence"].max()) + 1

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
