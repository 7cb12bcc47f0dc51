"""Substring scans over lower-cased text, as one boolean or array Column per word list.

Callers lower-case once in an earlier projection and pass that column in: a `lower()` repeated
inside every `contains` would be evaluated once per term.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(items: Sequence[str]) -> Column:
    """A literal array of strings, parsed in one call: a literal per word costs a call each."""
    return F.expr("array(" + ", ".join(quoted(item) for item in items) + ")")


def in_words(name: str, items: Sequence[str]) -> str:
    """SQL text of a set test; Catalyst turns it into a hash look-up."""
    return f"{name} IN (" + ", ".join(quoted(item) for item in items) + ")"


def any_match(lowered: Column, terms: Sequence[str]) -> Column:
    """True when any term occurs in the text; null text matches nothing.

    A loop over a literal array: a chain of `contains` per term outgrows what the JVM compiles.
    """
    return F.coalesce(F.exists(strings(terms), lambda term: F.contains(lowered, term)), F.lit(False))


def matching_names(lowered: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Names of the groups with a matching term, in the order of the mapping."""
    return F.array_compact(
        F.array(*[F.when(any_match(lowered, terms), F.lit(name)) for name, terms in groups.items()])
    )


def with_lowered(df: DataFrame, **columns: str) -> DataFrame:
    """Add lower-cased copies, `with_lowered(df, low_text="narrative")`; null becomes empty."""
    return df.withColumns({out: F.lower(F.coalesce(F.col(src), F.lit(""))) for out, src in columns.items()})
