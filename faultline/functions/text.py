"""Text normalisation as Column expressions; `normalise` runs on Arrow batches (`wordwork`).

Every step works inside one row, so none of it shuffles. The patterns use only constructs that
mean the same in Java and RE2 expressions (no look-around).
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions import lexicon, wordwork
from faultline.functions.matching import in_words, quoted

SPACES = r"[\p{Z}\s]+"
# Characters that stand alone between words, white space of every kind among them.
SEPARATORS = (
    ";@#$%&?![](){}<>\"«»“”„‘’…`"
    "\t\n\r\f\x0b\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
COMMA_OR_COLON = r"([:,])([^0-9])"
CLOSING = r"(?:'(?:s|m|d|ll|re|ve)?|n't|[.:,])+( |$)"
WORD = r"^[\p{L}\p{N}]+$"
# Words written as one that the tokeniser takes apart, as (first, second).
JOINED = (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"))
LINE_BREAK = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
SENTENCE_END = r"([.!?])\s+"
SENTENCE_MARK = "\u0001"
WHITESPACE_CHARS = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def snippet(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def lemma_sql(word: str) -> str:
    """SQL text: singular form of an English noun by suffix rules, irregular nouns first."""
    pairs = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in lexicon.IRREGULAR_NOUNS.items())
    es_plural = " OR ".join(f"endswith({word}, '{end}')" for end in ("sses", "xes", "zes", "ches", "shes"))
    no_plural = " OR ".join(f"endswith({word}, '{end}')" for end in ("ss", "is", "us"))
    return f"""
        CASE WHEN {in_words(word, list(lexicon.IRREGULAR_NOUNS))} THEN element_at(map({pairs}), {word})
             WHEN endswith({word}, 's') THEN
                 CASE WHEN endswith({word}, 'ies') AND length({word}) >= 5 THEN left({word}, length({word}) - 3) || 'y'
                      WHEN {es_plural} THEN left({word}, length({word}) - 2)
                      WHEN length({word}) >= 4 AND NOT ({no_plural}) THEN left({word}, length({word}) - 1)
                      ELSE {word} END
             WHEN endswith({word}, 'men') AND length({word}) >= 5 THEN left({word}, length({word}) - 3) || 'man'
             ELSE {word} END
    """


def _each(function: str, array: Column, body: str) -> Column:
    """A higher-order function with its lambda `w -> body` given as SQL text."""
    return F.call_function(function, array, F.expr(f"w -> {body}"))


def split_joined(text: Column) -> Column:
    """Joined words taken apart in one pass; texts that hold none of them are passed on as they are.

    A group that took no part in a match is replaced by nothing, so first halves and second halves of
    all words stand in one replacement. The lambda names the text, which is computed once.
    """
    pattern = r"\b(?:" + "|".join(f"({first})({second})" for first, second in JOINED) + r")\b"
    halves = ["".join(f"${2 * i + n}" for i in range(len(JOINED))) for n in (1, 2)]

    def apart(t: Column) -> Column:
        any_of = functools.reduce(Column.__or__, [F.contains(t, F.lit(a + b)) for a, b in JOINED])
        return F.when(any_of, F.regexp_replace(t, pattern, " ".join(halves))).otherwise(t)

    return F.get(F.transform(F.array(text), apart), F.lit(0))


def core_tokens(text: Column) -> Column:
    """Words of a narrative: punctuation split off, purely alphanumeric tokens kept."""
    spaced = F.translate(F.lower(text), SEPARATORS, " " * len(SEPARATORS))
    for run in ("--", "..."):
        spaced = F.replace(spaced, F.lit(run), F.lit(" "))
    spaced = F.regexp_replace(spaced, COMMA_OR_COLON, " $2")
    spaced = F.regexp_replace(spaced, CLOSING, "$1")
    spaced = split_joined(spaced)
    wanted = f"w RLIKE {quoted(WORD)} AND NOT {in_words('w', lexicon.STOPWORDS)}"
    return _each("filter", F.split(spaced, " "), wanted)


PROFILES = ("core", "api")


def normalise(text: Column, profile: str = "core", lemmas: bool = True) -> Column:
    """Normalised text of one profile: lower-case words, stopwords out, nouns singular."""
    if profile not in PROFILES:
        raise ValueError(f"no text profile {profile}")
    wordwork.travel_with_tasks()
    rules = wordwork.Normaliser(
        profile=profile,
        separators=SEPARATORS,
        comma_or_colon=COMMA_OR_COLON,
        closing=CLOSING,
        word=WORD,
        joined=JOINED,
        stopwords=frozenset(lexicon.STOPWORDS),
        irregular=lexicon.IRREGULAR_NOUNS if lemmas else None,
    )

    def normalised(lowered: pa.Array) -> pa.Array:
        return rules(lowered)

    return F.arrow_udf(normalised, "string")(F.lower(text))


def vector_words(processed: Column) -> Column:
    """Words the term vectors are built of: two characters or more, vectoriser stopwords out."""
    ignored = lexicon.STOPWORDS + lexicon.VECTOR_STOPWORDS
    return _each("filter", F.split(processed, " "), f"length(w) >= 2 AND NOT {in_words('w', ignored)}")


def with_bigrams(words: Column) -> Column:
    """The words followed by each pair of neighbours. Pass a column, not an expression."""
    pairs = F.zip_with(
        words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.concat(words, F.array_compact(pairs))


def clean_lines(text: Column, min_chars: int = 40, banner_chars: int = 60) -> Column:
    """Lines of a report worth reading: long enough, no page furniture, no numbers or banners."""
    lines = F.transform(
        F.split(text, LINE_BREAK), lambda line: F.btrim(F.regexp_replace(line, SPACES, " "))
    )

    def keep(line: Column) -> Column:
        furniture = F.lower(line).rlike("|".join(re.escape(term) for term in lexicon.REPORT_NOISE))
        banner = (F.length(line) > banner_chars) & (F.upper(line) == line) & (F.lower(line) != line)
        return (F.length(line) >= min_chars) & ~furniture & ~line.rlike(r"^\p{Nd}+$") & ~banner

    return F.filter(lines, keep)


def sentences(lines: Column, min_chars: int = 20) -> Column:
    marked = F.regexp_replace(F.array_join(lines, " "), SENTENCE_END, f"$1{SENTENCE_MARK}")
    parts = F.transform(F.split(marked, SENTENCE_MARK), lambda part: F.btrim(part))
    return F.filter(parts, lambda part: F.length(part) >= min_chars)


def sentence_groups(kept: Column, group: int = 5) -> Column:
    """Every `group` sentences joined, the last group may be short. Pass a column."""
    starts = F.sequence(F.lit(1), F.size(kept), F.lit(group))
    grouped = F.transform(starts, lambda start: F.array_join(F.slice(kept, start, F.lit(group)), " "))
    return F.when(F.size(kept) > 0, grouped).otherwise(F.lit([]).cast("array<string>"))


def redact_paths(line: Column) -> Column:
    for old, new in lexicon.PATH_REPLACEMENTS:
        line = F.replace(line, F.lit(old), F.lit(new))
    return line


def redact_paths_for_display(line: Column) -> Column:
    """The stricter form used on screen: the rest of a line after a private path is hidden."""
    # What counts as a path on screen and what is shown instead.
    line = F.regexp_replace(line, r"[A-Za-z]:\\[\\/A-Za-z0-9_. -]+", "[system-path]")
    # a run with a slash shows what follows the last one; one that ends with a slash is hidden
    run = r"\\[\\/A-Za-z0-9_. -]*/"
    line = F.regexp_replace(line, run + r"([^\\/A-Za-z0-9_. -]|$)", "[system-path]$1")
    line = F.regexp_replace(line, run + r"([\\A-Za-z0-9_. -]+)", "$1")
    line = F.regexp_replace(line, r"(?i)/Users/[^\n]+", "[user-path]")
    line = F.regexp_replace(line, r"(?i)/home/[^\n]+", "[home-path]")
    return F.regexp_replace(line, r"(?i)/workspace/[^\n]+", "[workspace-path]")


def safe_file_id(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def content_key(narrative: Column) -> Column:
    return F.left(F.sha1(narrative), F.lit(16))
