"""Token counts that follow edits without encoding a text anew.

A document's pre-tokens are the leaves of a segment tree with characters and tokens summed in every
node. An edit is found by walking down the character sums. The region it touches is split anew from
a leaf before it (the pattern looks at most two characters ahead) until a new boundary meets an old
one; only those pre-tokens are encoded, and the sums on the way to the root follow.

Defined results: a null or empty text has no tokens and no edits; very long texts need memory in
proportion to their own length; repeated rows are counted one by one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from faultline.llm import packing, textstats

# Characters past its end that the pre-token pattern may look at.
LOOK_AHEAD = 2
# Counts of pre-tokens a task remembers before it starts over.
REMEMBERED = 1 << 19
Edit = tuple[int, int, str]


class Counter:
    """Tokens of single pre-tokens, remembered."""

    def __init__(self, files: tuple[str, str, str]) -> None:
        self.split = regex.compile(files[2])
        self.encode = packing.encoder(*files)
        self.known: dict[str, int] = {}

    def tokens(self, words: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = len(self.encode(w))
        return [known[w] for w in words]


class TokenTree:
    """Sums of characters and tokens over the pre-tokens of one text."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter = counter
        words = counter.split.findall(text)
        self.size = 1 << max(0, len(words) - 1).bit_length()
        self.words: list[list[str]] = [[w] for w in words]
        self.encoded = 0
        leaves = np.zeros((2, self.size), dtype=np.int64)
        leaves[0, : len(words)] = [len(w) for w in words]
        leaves[1, : len(words)] = counter.tokens(words)
        levels = [leaves]
        while levels[-1].shape[1] > 1:
            levels.append(levels[-1][:, 0::2] + levels[-1][:, 1::2])
        # node 1 is the root, the children of node i are 2i and 2i + 1
        whole = np.concatenate([np.zeros((2, 1), dtype=np.int64), *reversed(levels)], axis=1)
        self.chars, self.tokens = whole[0].tolist(), whole[1].tolist()

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(w for leaf in self.words for w in leaf)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf that holds a character, the leaf's first character); the last leaf for places past the end."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, words: list[str]) -> None:
        self.words[leaf] = words
        node = self.size + leaf
        change = [sum(map(len, words)) - self.chars[node], sum(self.counter.tokens(words)) - self.tokens[node]]
        while node:
            self.chars[node] += change[0]
            self.tokens[node] += change[1]
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from `start` to `end`, places as they are now."""
        if not self.words:
            fresh = TokenTree(new, self.counter)
            fresh.encoded = self.encoded + len(new)
            self.__dict__ = fresh.__dict__
            return
        first, at = self.leaf_at(max(0, start - LOOK_AHEAD))
        # what the leaves hold from `first` on, up to the edit's end and as far as it takes to meet
        last, held = first, []
        reach = at
        while last < len(self.words) and (reach < end or last == first):
            held += self.words[last]
            reach += sum(map(len, self.words[last]))
            last += 1
        old = "".join(held)
        head = old[: start - at] + new
        while True:
            # old boundaries after the edit, as places of the rewritten region
            tail = old[end - at :]
            region = head + tail
            ahead = self._ahead(last)
            pieces, spot = [], 0
            for match in self.counter.split.finditer(region + ahead):
                if match.start() >= len(region):
                    break
                pieces.append(match.group())
                spot = match.end()
            # it meets if a new boundary is where the next untouched leaf starts
            if spot == len(region) or last >= len(self.words):
                break
            more = "".join(self.words[last])
            old += more
            last += 1
        self.encoded += len(region)
        self._set(first, pieces)
        for leaf in range(first + 1, last):
            if self.words[leaf]:
                self._set(leaf, [])

    def _ahead(self, leaf: int) -> str:
        """Enough of what follows for the pattern to decide where the region's last pre-token ends."""
        out = ""
        while leaf < len(self.words) and len(out) <= LOOK_AHEAD:
            out += "".join(self.words[leaf])
            leaf += 1
        return out


def clean_up(text: str) -> list[Edit]:
    """Edits of a usual clean-up: lines equal to an earlier line go, a run of blanks becomes one."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        end = at + len(line)
        if textstats.WORD.search(line):
            if line in seen:
                edits.append((max(0, at - 1), end, ""))
            else:
                edits += [(at + m.start(), at + m.end(), " ") for m in regex.finditer(r"\x20{2,}", line)]
            seen.add(line)
        at = end + 1
    return edits


SCHEMA = "doc_id long, n_edits long, tokens_before long, tokens_after long, chars_after long, chars_encoded long"
FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]


def counted(
    docs: DataFrame,
    edits_of: Callable[[str], list[Edit]] = clean_up,
    tokenizer: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Token counts of every text before and after its edits (in order, not overlapping)."""
    files = tokenizer or packing.tokenizer_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(files)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                tree = TokenTree(text or "", counter)
                before = tree.total
                edits = edits_of(text or "")
                # from the end, so that places of earlier edits still hold
                for start, end, new in reversed(edits):
                    tree.edit(start, end, new)
                rows.append((len(edits), before, tree.total, tree.chars[1], tree.encoded))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(c, type=pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=FIELDS)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
