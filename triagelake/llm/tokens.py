"""Token counts by byte-pair merging, without producing tokens.

A piece of text starts as one symbol per byte. A heap holds the adjacent pairs that the
vocabulary can merge, by rank and place; a doubly linked list of symbols keeps neighbours.
The lowest pair is popped and merged until none is left. The number of tokens is the
number of bytes minus the number of merges.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

# How a text is cut into pieces before merging, as byte-level vocabularies prescribe (fixed value).
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Counts of pieces each task remembers before it starts anew; memory, not results, depends on it.
REMEMBERED = 500_000
# Bits of a symbol's number inside a packed pair.
PACK = 32

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_symbols() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    written = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [written[b] for b in range(256)]


def merge_table(merges: list, letters: list[str]) -> dict[int, int]:
    """What two adjacent symbols merge to, by their numbers packed into one.

    Bytes are symbols 0 to 255; the merge of rank r makes symbol 256 + r, so the smallest
    result is the merge to do first.
    """
    numbers = {letter: i for i, letter in enumerate(letters)}
    table: dict[int, int] = {}
    for rank, merge in enumerate(merges):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        table[numbers[a] << PACK | numbers[b]] = 256 + rank
        numbers[a + b] = 256 + rank
    return table


def count_tokens(data: bytes, merges: dict[int, int]) -> int:
    """Symbols that remain of the bytes when the lowest-ranked adjacent pairs have been merged."""
    left = len(data)
    if left < 2:
        return left
    symbols = [*data, -1]
    # Entries are result << 32 | place; results grow with rank.
    heap = [
        made << 32 | i
        for i in range(left - 1)
        if (made := merges.get(symbols[i] << PACK | symbols[i + 1], 0))
    ]
    if not heap:
        return left
    heapify(heap)
    end = left
    following = list(range(1, end + 1))
    preceding = list(range(-1, end - 1))
    while heap:
        entry = heappop(heap)
        i, made = entry & 0xFFFFFFFF, entry >> 32
        j = following[i]
        # Stale if the symbol at i is gone or either has grown since.
        if symbols[i] < 0 or j >= end or merges.get(symbols[i] << PACK | symbols[j]) != made:
            continue
        symbols[i] = made
        symbols[j] = -1
        left -= 1
        after = following[i] = following[j]
        if after < end:
            preceding[after] = i
            if then := merges.get(made << PACK | symbols[after]):
                heappush(heap, then << 32 | i)
        before = preceding[i]
        if before >= 0 and (then := merges.get(symbols[before] << PACK | made)):
            heappush(heap, then << 32 | before)
    return left


def text_counter(vocabulary: str) -> Callable[[str], int]:
    """A function from a whole text to its number of tokens under a byte-level vocabulary file.

    Strings of added tokens inside a text count as one token each, as the file declares them.
    """
    import unicodedata

    import regex

    with open(vocabulary, encoding="utf-8") as f:
        rules = json.load(f)
    merges = merge_table(rules["model"]["merges"], byte_symbols())
    added = sorted((t["content"] for t in rules["added_tokens"]), key=len, reverse=True)
    special = regex.compile("|".join(map(regex.escape, added))) if added else None
    pieces = regex.compile(PIECES)
    # Characters younger than this Python's Unicode tables: their class depends on who asks.
    unknown = "".join(c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn")
    young = set(regex.findall(r"[\p{L}\p{N}\s]", unknown))
    remembered: dict[str, int] = {}

    def cut_up(part: str) -> list[str]:
        if part.isascii() or young.isdisjoint(part):
            return pieces.findall(part)
        from tokenizers import pre_tokenizers

        cutter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        return [part[a:b] for _, (a, b) in cutter.pre_tokenize_str(part)]

    def of_part(part: str) -> int:
        total = 0
        for piece in cut_up(part):
            n = remembered.get(piece)
            if n is None:
                if len(remembered) >= REMEMBERED:
                    remembered.clear()
                n = count_tokens(piece.encode(), merges)
                # Long pieces seldom recur and would weigh on memory.
                if len(piece) <= 64:
                    remembered[piece] = n
            total += n
        return total

    def of_text(text: str) -> int:
        if special is None or not special.search(text):
            return of_part(text)
        found = special.findall(text)
        return len(found) + sum(of_part(p) for p in special.split(text) if p)

    return of_text


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row.

    ``vocabulary`` is the path of a byte-level file that every executor can read. A null
    text is an empty one and has no tokens. Rows are counted one by one: ids may repeat or
    be null, other columns are left out, an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or text_counter(vocabulary)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([counter(t) for t in texts], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)
