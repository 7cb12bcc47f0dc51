"""Normalising texts on Arrow batches; runs inside tasks.

Only pyarrow and the standard library are used, and the module travels with the task, so executors need
no copy of this package. Patterns run over whole columns; words are tested and made singular once per
distinct word of a batch. Texts come lower-cased.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

NOT_LETTERS = "[^a-z]+"
SINGULAR_END = ("ss", "is", "us")
ES_PLURAL = ("sses", "xes", "zes", "ches", "shes")


@dataclass
class Normaliser:
    """Word rules of one profile; `joined` words are taken apart, `irregular` maps plural nouns to singular ones."""

    profile: str
    separators: str
    comma_or_colon: str
    closing: str
    word: str
    joined: Sequence[tuple[str, str]]
    stopwords: frozenset[str]
    irregular: Mapping[str, str] | None

    def __post_init__(self) -> None:
        self.separator = re.compile("[" + re.escape(self.separators) + "]")
        self.halves = {first + second: f"{first} {second}" for first, second in self.joined}
        self.joined_word = re.compile(r"\b(?:" + "|".join(self.halves) + r")\b")

    def spaced(self, texts: pa.Array) -> pa.Array:
        if self.profile == "api":
            return pc.replace_substring_regex(texts, pattern=NOT_LETTERS, replacement=" ")
        separate = self.separator.sub
        texts = pa.array([None if t is None else separate(" ", t) for t in texts.to_pylist()], pa.large_string())
        for run in ("--", "..."):
            texts = pc.replace_substring(texts, pattern=run, replacement=" ")
        texts = pc.replace_substring_regex(texts, pattern=self.comma_or_colon, replacement=r" \2")
        return pc.replace_substring_regex(texts, pattern=self.closing, replacement=r"\1")

    def apart(self, texts: pa.Array) -> pa.Array:
        """Joined words taken apart; texts that hold none of them are passed on as they are."""
        held = pc.fill_null(pc.match_substring_regex(texts, pattern="|".join(self.halves)), False)
        found = pc.filter(texts, held).to_pylist()
        if not found:
            return texts
        split = [self.joined_word.sub(lambda match: self.halves[match[0]], text) for text in found]
        return pc.replace_with_mask(texts, held, pa.array(split, texts.type))

    def wanted(self, words: pa.Array) -> list[str | None]:
        """What each distinct word becomes, or nothing where it is left out."""
        if self.profile == "api":
            kept = pc.greater(pc.utf8_length(words), 2)
        else:
            kept = pc.match_substring_regex(words, pattern=self.word)
        pairs = zip(words.to_pylist(), kept.to_pylist())
        return [self.lemma(word) if keep and word not in self.stopwords else None for word, keep in pairs]

    def lemma(self, word: str) -> str:
        """Singular form of an English noun by suffix rules, irregular nouns first."""
        if self.irregular is None:
            return word
        if word in self.irregular:
            return self.irregular[word]
        if word.endswith("s"):
            if word.endswith("ies") and len(word) >= 5:
                return word[:-3] + "y"
            if word.endswith(ES_PLURAL):
                return word[:-2]
            return word[:-1] if len(word) >= 4 and not word.endswith(SINGULAR_END) else word
        return word[:-3] + "man" if word.endswith("men") and len(word) >= 5 else word

    def __call__(self, lowered: pa.Array) -> pa.Array:
        texts = pc.cast(lowered, pa.large_string())
        if self.profile == "api":
            texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(self.apart(self.spaced(texts)), " ")
        encoded = pc.dictionary_encode(pc.list_flatten(lists))
        becomes = pa.array(self.wanted(encoded.dictionary), pa.large_string())
        words = pc.take(becomes, encoded.indices)
        kept = pc.is_valid(words)
        # Words before each text's first one, of all and of those kept.
        sizes = pc.fill_null(pc.list_value_length(lists), 0)
        ends = pc.cumulative_sum(pc.cast(sizes, pa.int64()))
        kept_before = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.cast(kept, pa.int64()))])
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.take(kept_before, ends)])
        held = pa.LargeListArray.from_arrays(offsets, pc.filter(words, kept))
        joined = pc.binary_join(held, pa.scalar(" ", pa.large_string()))
        return pc.cast(pc.if_else(pc.is_valid(texts), joined, pa.scalar(None, pa.large_string())), pa.string())


def travel_with_tasks() -> None:
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
