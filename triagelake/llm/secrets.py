"""Secrets in texts: base patterns, and values in the context of credentials that are costly to guess.

Password guess-cost dynamic programming: a value is cut into words, dates, repeats, keyboard
walks and brute-force spans so that the guesses of the pieces, multiplied, are as few as
they can be. A value that takes many guesses even so is a secret; ``changeme``, ``qwerty123`` or a
date behind ``password:`` is not. Each text is looked at once, whole, where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.words import apart

# Bits of guesses from which a value counts as a secret: a fast machine's days.
MIN_BITS = 35.0
MASK = "[secret]"

# Base patterns, and how long a match (for assign: its value) has to be. Kinds in the order of the output.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEXADECIMAL = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole, so shorter ones need no second look
MIN_ASSIGNED, MIN_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "value")

# A text without any of these, in lower case, has no assignment and no credential's context.
STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "://")
# Names that announce a credential, what stands between, and the value: quoted, or up to a space.
CONTEXT = re.compile(
    r"(?:(?<![A-Za-z])(?:[a-z0-9]+[_-])*(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_-]?key|credentials?|auth(?:orization)?)"
    r"(?:[\"']?\s{0,4}(?:=>|:=|[:=])\s{0,4}|\x20is\x20)(?:(?:bearer|basic)\x20+)?"
    r"|(?<![A-Za-z])bearer\x20+"
    r"|://[^\s:/@\"'<>]{0,64}:(?=[^\s/@\"'<>]+@))"
    r"(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"'<>,;@]+))",
    re.IGNORECASE | re.ASCII,
)
# A value that only names another place.
REFERENCE = re.compile(r"[$%<{\[(]")
AROUND = ".,;:!?)]}\"'"

# Words that stand in passwords and examples, most usual first.
COMMON = (
    "password pass admin secret token key test default example change me changeme user root login welcome letmein guest "
    "master hello dragon monkey football baseball shadow sunshine princess superman batman iloveyou love money access "
    "server system database data service account public private api auth client your my the this here none null true "
    "false value string insert replace dummy sample placeholder foo bar baz demo dev prod staging local localhost "
    "internal temp summer winter spring autumn january february march april june july august september october "
    "november december monday tuesday wednesday thursday friday saturday sunday house computer internet security "
    "company office world freedom michael jordan thomas charlie"
).split()
WORDS: Mapping[str, int] = {w: rank for rank, w in enumerate(COMMON, 1)}
LONGEST_WORD = 24
# A run of letters that can be spoken counts as a word of this rank, whatever the language.
UNLISTED_RANK = 200_000
SPOKEN = re.compile(r"(?!.*[^aeiouyáéíóúàèìòùâêîôûäëïöüæœ]{5})(?!.*[aeiouyáéíóúàèìòùâêîôûäëïöüæœ]{5})(?=.*[aeiouyáéíóúàèìòùâêîôûäëïöüæœ]).{2,20}", re.DOTALL)
LETTERS = re.compile(r"[^\W\d_]+")
# Characters that stand for letters.
PLAIN_FORM = str.maketrans("@0134$57", "aoieasst")

# Days of two hundred years, ways to write one, years alone.
DATE_BITS = log2(365.25 * 200) + 2
YEAR_BITS = log2(200)
DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])(?!\d)|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d(?!\d)",
    re.ASCII,
)
YEAR = re.compile(r"(?:19|20)\d\d", re.ASCII)
# One character between words.
SEPARATORS, SEPARATOR_BITS = "_-./ ", 2.0

# The rows of a keyboard, and the alphabet as one more.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEAST_WALK = 4
LEAST_REPEAT = 3
LONGEST_PERIOD = 8


def _neighbours() -> dict[tuple[str, str], str]:
    """The direction from one key to the next, along a row or from row to row."""
    found: dict[tuple[str, str], str] = {}
    for at, row in enumerate(ROWS):
        for i, c in enumerate(row):
            if i + 1 < len(row):
                found.setdefault((c, row[i + 1]), f"right{at == 4}")
                found.setdefault((row[i + 1], c), f"left{at == 4}")
            below = ROWS[at + 1] if at < 3 else ""
            for name, j in (("down", i), ("aslant", i - 1)):
                if 0 <= j < len(below):
                    found.setdefault((c, below[j]), name)
                    found.setdefault((below[j], c), f"back {name}")
    return found


NEXT_KEY = _neighbours()
START_BITS, TURN_BITS = log2(47), log2(6)


def character_bits(c: str) -> float:
    """Brute force: guesses for one character among those of its class."""
    if c.isascii():
        return log2(10) if c.isdigit() else log2(26) if c.isalpha() else log2(33)
    return log2(100)


def pieces(value: str, words: Mapping[str, int] = WORDS) -> Iterator[tuple[int, int, float]]:
    """(start, end, bits) of what in ``value`` is easier to guess than its characters one by one."""
    low = value.lower()
    if len(low) != len(value):
        low = value
    plain = low.translate(PLAIN_FORM)
    for form, extra in ((low, 0.0), (plain, 1.0)) if plain != low else ((low, 0.0),):
        for i in range(len(form)):
            for j in range(i + 2, min(len(form), i + LONGEST_WORD) + 1):
                rank = words.get(form[i:j])
                if rank:
                    yield i, j, log2(rank + 1) + _case_bits(value[i:j]) + extra
    for m in LETTERS.finditer(value):
        for i, j in _parts(m.group(), m.start()):
            if SPOKEN.fullmatch(low[i:j]):
                yield i, j, log2(UNLISTED_RANK) + _case_bits(value[i:j])
    for i in range(len(value)):
        if value[i] in SEPARATORS:
            yield i, i + 1, SEPARATOR_BITS
        if value[i].isdigit():
            if m := DATE.match(value, i):
                yield i, m.end(), DATE_BITS
            if m := YEAR.match(value, i):
                yield i, m.end(), YEAR_BITS
    for period in range(1, LONGEST_PERIOD + 1):
        yield from _repeats(value, period)
    yield from _walks(low, value)


def _parts(letters: str, at: int) -> Iterator[tuple[int, int]]:
    """A run of letters, and the parts it has where a small letter is followed by a large one."""
    yield at, at + len(letters)
    edges = [0, *(i for i in range(1, len(letters)) if letters[i].isupper() and letters[i - 1].islower()), len(letters)]
    if len(edges) > 2:
        yield from ((at + i, at + j) for i, j in zip(edges, edges[1:], strict=False))


def _case_bits(piece: str) -> float:
    """Large letters: none, the first, all, or any."""
    large = sum(c.isupper() for c in piece)
    if not large:
        return 0.0
    return 1.0 if large == len(piece) or large == 1 and piece[0].isupper() else float(min(large, len(piece) - large) + 1)


def _repeats(value: str, period: int) -> Iterator[tuple[int, int, float]]:
    """Longest runs in which a block of ``period`` characters comes again."""
    start = 0
    for i in range(period, len(value) + 1):
        if i == len(value) or value[i] != value[i - period]:
            if i - start >= max(2 * period, LEAST_REPEAT):
                yield start, i, sum(map(character_bits, value[start : start + period])) + log2((i - start) / period + 1)
            start = i - period + 1


def _walks(low: str, value: str) -> Iterator[tuple[int, int, float]]:
    """Longest runs in which every key lies next to the one before."""
    start, turns, way = 0, 0, None
    for i in range(1, len(low) + 1):
        to = NEXT_KEY.get((low[i - 1], low[i])) if i < len(low) else None
        if to is None:
            if i - start >= LEAST_WALK:
                yield start, i, START_BITS + log2(i - start) + TURN_BITS * turns + _case_bits(value[start:i])
            start, turns, way = i, 0, None
        else:
            turns += to != way
            way = to


def guess_bits(value: str, words: Mapping[str, int] = WORDS) -> float:
    """The least bits of guesses over all ways to cut ``value`` into pieces and single characters."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, bits in pieces(value, words):
        ending.setdefault(j, []).append((i, bits))
    least = [0.0]
    for j, c in enumerate(value, 1):
        least.append(min([least[j - 1] + character_bits(c), *(least[i] + bits for i, bits in ending.get(j, ()))]))
    return least[-1]


def names_credentials(text: str) -> bool:
    low = text.lower()
    return any(s in low for s in STEMS)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, kind by kind."""
    found = [("hex", m.start(), m.end()) for m in HEXADECIMAL.finditer(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if names_credentials(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_ASSIGNED]
    return found


def credential_values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the values that stand where credentials stand."""
    for m in CONTEXT.finditer(text):
        start, end = m.span(m.lastindex)
        if m.lastindex == 3:
            while end > start and text[end - 1] in AROUND:
                end -= 1
        if end > start and not REFERENCE.match(text, start):
            yield start, end


def find_spans(text: str | None, words: Mapping[str, int] = WORDS, min_bits: float = MIN_BITS) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, bits) by start, then kind; bits for the spans of the method only.

    A value that overlaps a base span is that span's already.
    """
    if not text:
        return []
    base = base_spans(text)
    found: list[tuple[str, int, int, float | None]] = [(*s, None) for s in base]
    if names_credentials(text):
        taken = sorted((start, end) for _, start, end in base)
        at, reached = 0, -1
        for start, end in credential_values(text):
            while at < len(taken) and taken[at][0] < end:
                reached = max(reached, taken[at][1])
                at += 1
            if reached > start:
                continue
            bits = guess_bits(text[start:end], words)
            if bits >= min_bits:
                found.append(("value", start, end, bits))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def with_secrets(docs: DataFrame, words: Mapping[str, int] = WORDS, min_bits: float = MIN_BITS, text: str = "text") -> DataFrame:
    """The rows with ``secrets``, an array of (kind, start, end, bits); places count code points, ends are exclusive.

    Null and empty texts have none. A column of the caller's with the name ``secrets`` stays
    and the array is not added. ``words`` is a bounded list with ranks, sent with the task.
    """
    packed, back = apart(docs, [text])
    kind = "array<struct<kind string, start long, end long, bits double>>"
    shape = packed.withColumn("secrets", F.lit(None).cast(kind))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            at = batch.schema.get_field_index("secrets")
            names = ("kind", "start", "end", "bits")
            rows = [[dict(zip(names, s, strict=True)) for s in find_spans(t.as_py(), words, min_bits)] for t in texts]
            yield batch.set_column(at, batch.schema.field(at), pa.array(rows, batch.schema.field(at).type))

    return back(shape.mapInArrow(search, shape.schema), "secrets")


def redact_secrets(docs: DataFrame, mask: str = MASK, words: Mapping[str, int] = WORDS, min_bits: float = MIN_BITS) -> DataFrame:
    """The rows with every secret in ``text`` replaced; spans that overlap are replaced as one. All columns stay."""

    def cleaned(text: str | None) -> str | None:
        out, at = [], 0
        for _, start, end, _ in find_spans(text, words, min_bits):
            if start >= at:
                out += [text[at:start], mask]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = pa.array([cleaned(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    packed, back = apart(docs, ["text"])
    return back(packed.mapInArrow(work, packed.schema))


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document: counts by kind, the digest of the base spans, and all spans as text.

    doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_values, strongest (most bits of a value, null without).
    Null and empty texts have no spans. Repeated rows are reported each.
    """
    found = with_secrets(docs.select("doc_id", "text")).drop("text")
    secrets = F.col("secrets")
    return found.select(
        "doc_id",
        *[F.size(_of_kind(secrets, k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed(F.filter(secrets, lambda s: s["kind"] != "value")), 256).alias("base_sha256"),
        _listed(secrets).alias("spans"),
        F.size(_of_kind(secrets, "value")).cast("long").alias("n_values"),
        F.array_max(F.transform(secrets, lambda s: s["bits"])).alias("strongest"),
    )
