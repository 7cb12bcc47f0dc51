"""Chat formatting with shared beginnings: conversations that start with the same turns are one prefix tree.

A turn is `<s>role[INST]text</s>`; strings of the template inside a role or text are broken with a
backslash, which takes itself as well, so every text can be had back. Conversations come to a task in the
order of their turns' hashes, so those with equal first turns follow each other, and the tree is walked
depth first: a turn the previous conversation has at the same place, after the same turns, is not
emitted again. A sequence holds part of the tree: its tokens, a position id for each (tokens of the
ancestors come before it, whatever else lies between), and for each turn the token intervals of its
ancestors, which are what it may attend to besides itself. Texts of the assistant are under the loss mask.

A sequence is closed before it exceeds `capacity` tokens; the next one repeats the turns its first
conversation shares. A conversation that is longer than a sequence is cut between turns; its parts are
sequences of their own, in order, and its positions count on. No task holds more than a sequence and a
conversation's worth of capacity. Beginnings beyond ORDERED_TURNS turns are shared between neighbours only.

Defined results: a null text or role is an empty one; turns are ordered by number, a null number last, ties by
role and text; repeated rows are turns of their own; rows without conv_id are one conversation without id;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from faultline.llm import packing
from faultline.llm.textstats import in_slices
from faultline.session import materialise

# The template's own strings.
START, BODY, END = "<s>", "[INST]", "</s>"
LEARNED_ROLE = "assistant"
# A backslash, or the place inside a control string where one is put.
BREAK = re.compile(r"\\|(?<=<)(?=/?s>|\|endoftext\|>)|(?<=\[)(?=/?INST\])")
TURN = re.compile(r"<s>(.*?)\[INST\](.*?)</s>", re.S)
BROKEN = re.compile(r"\\(.)", re.S)

CAPACITY = 32_768
# First turns that decide the order; an order key has eight bytes for each.
ORDERED_TURNS = 64

SPAN = "struct<start: int, end: int>"
NODE = f"struct<start: int, end: int, loss: {SPAN}, parent: int, intervals: array<{SPAN}>>"
MEMBER = "struct<conv_id: long, part: int, last: boolean, node: int>"
SCHEMA = (
    f"sequence_id long, tokens array<int>, position_ids array<int>, nodes array<{NODE}>, conversations array<{MEMBER}>"
)
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: str) -> str:
    return BREAK.sub(lambda m: "\\" + m.group(), text)


def unescaped(text: str) -> str:
    return BROKEN.sub(r"\1", text)


# ---- order


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNull().alias("unnumbered"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
    ).withColumn("hash", F.xxhash64("text"))


IN_ORDER = ("unnumbered", "turn", "role", "hash")


def _bytes(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value), 16, "0"))


def shared_paths(turns: DataFrame) -> DataFrame:
    """(owner, path) of the conversations whose first turn is another's as well: chained hashes of their first turns.

    Only hashes are shuffled; a long conversation gives its first ORDERED_TURNS turns.
    """
    light = turns.filter("conv_id is not null").select("conv_id", *IN_ORDER)
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(*IN_ORDER))
    heads = light.withColumn("place", rank).filter(F.col("place") <= ORDERED_TURNS)
    listed = heads.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role", "hash"))).alias("heads"))
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(b"").alias("path"))

    def further(chain: Column, head: Column) -> Column:
        h = F.xxhash64(chain["h"], head["role"], head["hash"])
        return F.struct(h.alias("h"), F.concat(chain["path"], _bytes(h)).alias("path"))

    path = F.aggregate("heads", start, further, lambda chain: chain["path"])
    paths = materialise(listed.select(F.col("conv_id").alias("owner"), path.alias("path")), "chat-paths")
    root = F.substring("path", 1, 8)
    shared = paths.groupBy(root.alias("root")).agg(F.count("*").alias("n")).filter("n > 1").select("root")
    shared = materialise(shared, "chat-roots")
    return materialise(paths.join(shared, root == F.col("root"), "left_semi"), "chat-shared")


# ---- trees


class Tree:
    """One sequence in the making."""

    def __init__(self, position: int = 0) -> None:
        self.tokens: list[np.ndarray] = []
        self.positions: list[np.ndarray] = []
        self.nodes: list[dict] = []
        self.members: list[dict] = []
        self.size = 0
        self.first_position = position
        self.path: list[tuple[tuple[str, str], int]] = []  # turns of the last conversation and their nodes

    def common(self, turns: list) -> int:
        """First turns that the last conversation has too."""
        n = 0
        while n < min(len(turns), len(self.path)) and self.path[n][0] == turns[n][0]:
            n += 1
        return n

    def add(self, conv_id: int | None, turns: list, part: int = 0, last: bool = True) -> None:
        del self.path[self.common(turns) :]
        for key, ids, (a, b) in turns[len(self.path) :]:
            parent = self.path[-1][1] if self.path else -1
            intervals, position = [], self.first_position
            if parent >= 0:
                above = self.nodes[parent]
                own = {"start": above["start"], "end": above["end"]}
                intervals = [dict(i) for i in above["intervals"]]
                if intervals and intervals[-1]["end"] == own["start"]:
                    intervals[-1]["end"] = own["end"]
                else:
                    intervals.append(own)
                position += sum(i["end"] - i["start"] for i in intervals)
            span = {"start": self.size, "end": self.size + len(ids)}
            loss = {"start": self.size + a, "end": self.size + b}
            self.nodes.append({**span, "loss": loss, "parent": parent, "intervals": intervals})
            self.tokens.append(ids)
            self.positions.append(np.arange(position, position + len(ids), dtype=np.int32))
            self.size += len(ids)
            self.path.append((key, len(self.nodes) - 1))
        self.members.append({"conv_id": conv_id, "part": part, "last": last, "node": self.path[-1][1]})

    def row(self, sequence_id: int) -> dict:
        tokens, positions = (np.concatenate(x).astype(np.int32) for x in (self.tokens, self.positions))
        return {
            "sequence_id": sequence_id, "tokens": tokens, "position_ids": positions, "nodes": self.nodes,
            "conversations": self.members,
        }


class Forest:
    """Puts conversations, one after the other and turn by turn, into sequences."""

    def __init__(self, encode, capacity: int) -> None:
        self.encode, self.capacity = encode, capacity
        self.tree = Tree()
        self.conv_id: int | None = None
        self.turns: list = []  # of the conversation being read: ((role, text), ids, loss span)
        self.size = self.before = self.part = 0

    def turn(self, role: str, text: str) -> tuple:
        pieces = [self.encode(piece) if piece else [] for piece in (START + escaped(role) + BODY, escaped(text), END)]
        a, b = len(pieces[0]), len(pieces[0]) + len(pieces[1])
        ids = np.concatenate([np.asarray(piece, dtype=np.uint32) for piece in pieces])
        return (role, text), ids, (a, b if role == LEARNED_ROLE else a)

    def read(self, role: str, text: str) -> Iterator[Tree]:
        made = self.turn(role, text)
        if self.turns and self.size + len(made[1]) > self.capacity:
            self.part += 1
            yield from self._cut(last=False)
        self.turns.append(made)
        self.size += len(made[1])

    def _cut(self, last: bool) -> Iterator[Tree]:
        if self.tree.members:
            yield self.tree
        self.tree = Tree(self.before)
        self.tree.add(self.conv_id, self.turns, self.part, last)
        yield self.tree
        self.before += self.size
        self.tree, self.turns, self.size = Tree(), [], 0

    def end(self) -> Iterator[Tree]:
        """The conversation is complete."""
        if not self.turns:
            return
        if self.part:
            self.part += 1
            yield from self._cut(last=True)
        else:
            new = sum(len(ids) for _, ids, _ in self.turns[self.tree.common(self.turns) :])
            if self.tree.members and self.tree.size + new > self.capacity:
                yield self.tree
                self.tree = Tree()
            self.tree.add(self.conv_id, self.turns)
        self.turns, self.size, self.before, self.part = [], 0, 0, 0

    def close(self) -> Iterator[Tree]:
        yield from self.end()
        if self.tree.members:
            yield self.tree


def format_chats(
    conversations: DataFrame, tokenizer: tuple[str, str, str] | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """One row per sequence: tokens, position ids, the turns with their intervals, and where each conversation ends."""
    files = tokenizer or packing.tokenizer_files()
    turns = _turns(conversations)
    moved = shared_paths(turns)
    alone = _bytes(F.xxhash64("conv_id"))
    placed = turns.join(moved, F.col("conv_id") == F.col("owner"), "left")
    placed = placed.select("conv_id", *IN_ORDER, "text", F.coalesce("path", alone).alias("path"))
    partitions = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(partitions, "path", "conv_id").sortWithinPartitions("path", "conv_id", *IN_ORDER)
    arrow = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(packing.encoder(*files), capacity)
        number = TaskContext.get().partitionId() << 36

        def rows(trees: Iterator[Tree]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for tree in trees:
                yield pa.RecordBatch.from_pylist([tree.row(number)], schema=arrow)
                number += 1

        started = False
        for batch in in_slices(batches):
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for conv_id, role, text in zip(*columns, strict=True):
                if not started or conv_id != forest.conv_id:
                    yield from rows(forest.end())
                    forest.conv_id, started = conv_id, True
                yield from rows(forest.read(role, text))
        yield from rows(forest.close())

    return dealt.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def in_order(sequences: DataFrame) -> DataFrame:
    """Sequences of a stored table with the parts of cut conversations together again, in order."""
    task = F.shiftright("sequence_id", 36)
    partitions = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sequences.repartition(partitions, task).sortWithinPartitions("sequence_id")


# ---- reading back


def paths(nodes: list[dict]) -> list[list[int]]:
    """The nodes from the first turn to each node."""
    out: list[list[int]] = []
    for i, node in enumerate(nodes):
        out.append([*(out[node["parent"]] if node["parent"] >= 0 else []), i])
    return out


class Reader:
    """One conversation read back from tokens, part by part."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, losses: list[str]) -> None:
        self.formatted_chars += len(formatted)
        for match in TURN.finditer(formatted):
            role, text = map(unescaped, match.groups())
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for loss in map(unescaped, losses):
            self.loss.update(loss.encode())
            self.loss_chars += len(loss)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def read_back(sequences: DataFrame, tokenizer: tuple[str, str, str] | None = None) -> DataFrame:
    """Counts and digests of every conversation, from nothing but the sequences.

    What a conversation sees is what its last turn attends to: the intervals of its ancestors and itself.
    Parts of a cut conversation have to lie in order, as `format_chats` and `in_order` leave them.
    """
    files = tokenizer or packing.tokenizer_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = packing.decoder(*files)
        reader = Reader()
        names = [part.split()[0] for part in DIGESTS.split(", ")]
        kinds = [pa.string() if "sha256" in name else pa.int64() for name in names]
        for batch in in_slices(batches, 1):
            tokens = batch.column("tokens")[0].values.to_numpy()
            nodes = batch.column("nodes")[0].as_py()
            way = paths(nodes)
            out = []
            for member in batch.column("conversations")[0].as_py():
                last = nodes[member["node"]]
                seen = [*last["intervals"], {"start": last["start"], "end": last["end"]}]
                formatted = decode(np.concatenate([tokens[i["start"] : i["end"]] for i in seen]))
                losses = [nodes[i]["loss"] for i in way[member["node"]]]
                reader.add(formatted, [decode(tokens[x["start"] : x["end"]]) for x in losses if x["end"] > x["start"]])
                if member["last"]:
                    out.append(reader.row(member["conv_id"]))
                    reader = Reader()
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            arrays = [pa.array(c, type=kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return sequences.select("tokens", "nodes", "conversations").mapInArrow(run, DIGESTS)
