"""Personal data in whole texts, plain and disguised, as spans of the source text.

Plain identifiers are found first. Then a chain of small transducers rewrites the text: look-alike
characters to ASCII, spelled digits to digits, spelled "at" and "dot" to their signs. Each keeps
for every character it writes the source span it stands for, so what is found in the rewritten text
maps back to the source. Spans found only there are added; plain ones stay.

Defined results: a null text is an empty one and has no spans; very long texts are searched in
linear time; repeated rows are searched one by one; an empty table gives no rows; other columns are
ignored (`mask` keeps them).
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.textstats import in_slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# Written by the transducers: a spelled dot, a spelled "at" without brackets. Private characters of
# the source are turned into U+FFFD first.
DOT, AT = "\ue001", "\ue002"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


# ---- identifiers of a text


def emails(text: str, signs: str = "@", local: frozenset = LOCAL, domain: re.Pattern = DOMAIN) -> list[Span]:
    """Leftmost non-overlapping; for every sign the characters before it and the domain after it are looked at once."""
    found, end = [], 0
    for sign in re.finditer(f"[{signs}]", text):
        at = start = sign.start()
        while start > end and text[start - 1] in local:
            start -= 1
        match = domain.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append((start, end))
    return found


def addresses(text: str) -> list[Span]:
    """Four numbers up to 255. In a longer chain each four are one match, as a search from the left gives them."""
    found = []
    for chain in CHAIN.finditer(text):
        parts = chain.group().split(".")
        start = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((start, start + size))
            start += size + 1
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for match in CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(match.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def plain_spans(text: str) -> dict[str, list[Span]]:
    found = {"email": emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    if DIGIT.search(text):
        found["ip"] = addresses(text) if "." in text else []
        found["card"] = cards(text)
        found["phone"] = phones(text) if "+" in text else []
    return found


# ---- transducers


@dataclass
class Mapped:
    """A text and, for each of its characters, the source span it stands for: two int32 per character."""

    text: str
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def plain(cls, text: str) -> Mapped:
        starts = np.arange(len(text), dtype=np.int32)
        return cls(text, starts, starts + np.int32(1))

    def rewrite(self, pattern: re.Pattern, change: Callable[[re.Match], str | None]) -> Mapped:
        """Replace matches; each new character stands for its whole match. None leaves a match as it is."""
        text, at = [], 0
        # runs of the new text: where each starts in the old one, its last old place, its length
        first, last, length = array("i"), array("i"), array("i")
        for match in pattern.finditer(self.text):
            new = change(match)
            if new is None or match.start() == match.end():
                continue
            a, b = match.span()
            text += [self.text[at:a], new]
            first.extend((at, a))
            last.extend((-1, b - 1))
            length.extend((a - at, len(new)))
            at = b
        if not at:
            return self
        text.append(self.text[at:])
        first.append(at)
        last.append(-1)
        length.append(len(self.text) - at)
        first, last, length = (np.frombuffer(x, dtype=np.int32) for x in (first, last, length))
        kept = last < 0
        # a kept run counts on from its first place, a new one stays at it
        step = np.repeat(kept, length)
        run = np.cumsum(length, dtype=np.int32) - length
        place = np.repeat(first, length)
        on = np.arange(len(place), dtype=np.int32) - np.repeat(run, length)
        place[step] += on[step]
        starts = self.starts[place]
        stays = ~step
        place[stays] = np.repeat(last, length)[stays]
        return Mapped("".join(text), starts, self.ends[place])


# Letters of other scripts that look like ASCII ones.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅ" "αεονρικυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ɑɡɩо" "‐‑‒–—−" "․｡。٫" "۔",
        "aeopcyxijsdhqwABEKMHOPCTYXIJS" "aeovpikuxABEZHIKMNOPTYX" "agio" "------" "...." ".",
        strict=True,
    )
)
ODD = re.compile("[\u00a0\u00ad\u00b2\u00b3\u00b9\u0250-\U0010ffff]")


@functools.lru_cache(1 << 16)
def ascii_of(char: str) -> str | None:
    """The ASCII character a character passes for, nothing for an invisible one, None for any other."""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    kind = unicodedata.category(char)
    if kind == "Cf" or "\ufe00" <= char <= "\ufe0f":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Co":
        return "\ufffd"
    digit = unicodedata.digit(char, None)
    if digit is not None:
        return str(digit)
    flat = unicodedata.normalize("NFKC", char)
    return flat if len(flat) == 1 and flat.isascii() else None


# The digits from 0 in the languages of the corpus, and how "at" and "dot" are spelled.
DIGIT_WORDS = (
    "zero oh|one|two|three|four|five|six|seven|eight|nine",
    "zéro|un|deux|trois|quatre|cinq|six|sept|huit|neuf",
    "null|eins|zwei|drei|vier|fünf|sechs|sieben|acht|neun",
    "cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve",
)
DIGIT_OF = {word: str(i) for names in DIGIT_WORDS for i, group in enumerate(names.split("|")) for word in group.split()}
AT_WORDS = r"at|ät|arobase|arroba"
DOT_WORDS = r"dot|punkt|point|punto"

_digit = r"(?<!\w)(?:" + "|".join(sorted(DIGIT_OF, key=lambda w: (-len(w), w))) + r")(?!\w)"
_gap = r"[\x20,\-]{1,3}"
# Spelled digits, also after "plus"; separators between them go.
SPELLED = re.compile(rf"(?:(?<!\w)plus{_gap})?{_digit}(?:{_gap}{_digit})*", re.I)
SPELLED_WORD = re.compile(_digit, re.I)
PLUS = re.compile(r"(?<!\w)plus\x20?(?=[0-9])", re.I)
MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OolI]*(?:[0-9][OolI]|[OolI][0-9])[0-9OolI]*(?![A-Za-z0-9])")
MIXED_DIGITS = str.maketrans("OolI", "0011")
BRACKET_AT = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{AT_WORDS}|@)\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
BRACKET_DOT = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:{DOT_WORDS}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}", re.I)
BARE_AT = re.compile(rf"(?<=\w)(?:[\x20\t]{{1,3}}|[-_])(?:{AT_WORDS})(?:[\x20\t]{{1,3}}|[-_])(?=\w)", re.I)
BARE_DOT = re.compile(rf"(?<=\w)(?:[\x20\t]{{1,3}}|[-_])(?:{DOT_WORDS})(?:[\x20\t]{{1,3}}|[-_])(?=\w)", re.I)
WIDE_AT = re.compile(r"(?<=[A-Za-z0-9])(?:\x20@\x20?|@\x20)(?=[A-Za-z0-9])")
HAS_DOT_WORD = re.compile(rf"(?:{DOT_WORDS})(?![^\W_])", re.I)

HIDDEN_LOCAL = LOCAL | {DOT}
HIDDEN_DOMAIN = re.compile(rf"[A-Za-z0-9-]+(?:[.{DOT}][A-Za-z0-9-]+)+")


# Cheap looks on the lower-case text; each starts with a set of characters that is rare or one step to test.
_bracketed = re.compile(rf"[\[({{<]\s{{0,3}}(?:{AT_WORDS}|{DOT_WORDS}|@|\.)\s{{0,3}}[\])}}>]")
_beside_digit = re.compile(r"[0-9](?:(?<=[OolI][0-9])|(?=[OolI]))")
_word = re.compile(r"\w+")
# Letters that patterns without case take for i and s, and lower() does not.
_folded = re.compile("[İıſ]")
_unfolded = str.maketrans("İıſ", "iis")


def disguised(text: str) -> bool:
    """Whether any transducer may have something to do: a linear look that most texts end with.

    It holds wherever one of their patterns matches, so leaving the others out changes no result.
    """
    if not text.isascii() and (ODD.search(text) or _folded.search(text)):
        return True
    low = text.lower()
    if _bracketed.search(low) or ("@" in text and WIDE_AT.search(text)):
        return True
    if any(w in low for w in DOT_WORDS.split("|")) and HAS_DOT_WORD.search(low):
        return True
    if "plus" in low and PLUS.search(text):
        return True
    return bool(_beside_digit.search(text)) or not DIGIT_OF.keys().isdisjoint(_word.findall(low))


def _spelled_digits(match: re.Match) -> str | None:
    words = SPELLED_WORD.findall(match.group())
    plus = match.group()[:4].lower() == "plus"
    return "+" * plus + "".join(DIGIT_OF[w.translate(_unfolded).lower()] for w in words)


def normalised(text: str) -> Mapped:
    mapped = Mapped.plain(text).rewrite(ODD, lambda m: ascii_of(m.group()))
    mapped = mapped.rewrite(BRACKET_AT, lambda m: "@")
    mapped = mapped.rewrite(BRACKET_DOT, lambda m: DOT)
    # without a spelled dot it never counts
    if DOT in mapped.text or BARE_DOT.search(mapped.text):
        mapped = mapped.rewrite(BARE_AT, lambda m: AT)
    mapped = mapped.rewrite(BARE_DOT, lambda m: DOT)
    mapped = mapped.rewrite(SPELLED, _spelled_digits)
    mapped = mapped.rewrite(PLUS, lambda m: "+")
    mapped = mapped.rewrite(MIXED, lambda m: m.group().translate(MIXED_DIGITS))
    return mapped.rewrite(WIDE_AT, lambda m: "@")


def hidden_spans(text: str) -> dict[str, list[Span]]:
    """Identifiers of the rewritten text, as source spans."""
    mapped = normalised(text)
    plain = mapped.text.replace(DOT, ".")
    # an "at" without brackets counts only before a spelled dot
    mail = [
        (a, b)
        for a, b in emails(mapped.text, "@" + AT, HIDDEN_LOCAL, HIDDEN_DOMAIN)
        if AT not in mapped.text[a:b] or DOT in mapped.text[mapped.text.index(AT, a) : b]
    ]
    found = {"email": mail, "ip": addresses(plain), "card": cards(plain), "phone": phones(plain)}
    return {kind: [(int(mapped.starts[a]), int(mapped.ends[b - 1])) for a, b in spans] for kind, spans in found.items()}


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(plain spans, all spans) by kind, in code points, end exclusive."""
    text = text or ""
    base = plain_spans(text)
    if not disguised(text):
        return base, base
    every = {}
    for kind, spans in hidden_spans(text).items():
        known = base[kind]
        inside = _inside(spans, known)
        every[kind] = sorted(known + [s for s, old in zip(spans, inside, strict=True) if not old])
    return base, every


def _inside(spans: list[Span], known: list[Span]) -> list[bool]:
    """Whether each span lies in a known one; both are in order of their starts."""
    out, i = [], 0
    for a, b in spans:
        while i < len(known) and known[i][1] < b:
            i += 1
        out.append(i < len(known) and known[i][0] <= a)
    return out


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def masked(text: str | None) -> str | None:
    """The text with each run of overlapping spans replaced by the kind of its first span."""
    if not text:
        return text
    spans = sorted((a, b, kind) for kind, found in find(text)[1].items() for a, b in found)
    pieces, at = [], 0
    last = None
    for a, b, kind in spans:
        if last and a < at:
            at = max(at, b)
        else:
            pieces += [text[at:a], f"<{kind.upper()}>"]
            at = b
        last = kind
    return "".join([*pieces, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]


def scan(docs: DataFrame) -> DataFrame:
    """Counts of plain identifiers, the digest of their spans and all spans, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = find(text)
                counts = [len(base[kind]) for kind in KINDS]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                added = sum(map(len, every.values())) - sum(counts)
                rows.append((*counts, digest, joined(every), added))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            arrays = [pa.array(c, type=kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=FIELDS)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def mask(docs: DataFrame, column: str = "text") -> DataFrame:
    """The rows of `docs` with the identifiers of a text column masked; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            place = batch.schema.get_field_index(column)
            new = pa.array([masked(t) for t in batch.column(place).to_pylist()], type=batch.schema.field(place).type)
            arrays = [new if i == place else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
