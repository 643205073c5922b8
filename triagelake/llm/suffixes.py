"""Suffix-array dedup: remove every byte that lies in a string of 400 bytes found twice.

Sorting all suffixes of a large corpus is out of reach, so only suffixes that matter are
sorted. Every window of 400 bytes has an anchor, the 32-byte gram in it with the smallest
hash (the first of equals). Equal windows have equal anchors at equal places, so a window
repeats if and only if another occurrence of its anchor agrees with it on the bytes left of
the anchor and right of it. A run of windows with one anchor is one row:

1. Runs are keyed by over 200 bytes beside the anchor that all their windows hold. Keys
   seen once are done: nothing there repeats.
2. Runs equal as a whole repeat wholly; one of them goes on for the others.
3. Per key, the strings that go right from the anchor and those that go left are put in
   suffix order by deep-shallow sorting: multikey quicksort to a shallow depth, then a
   blind trie for each group that is still equal there. The common prefixes of neighbours
   say for every offset which runs agree on both sides.
4. Keys with very many different runs are not sorted in one task: their windows are
   hashed one by one and counted in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.words import apart, text_key
from triagelake.session import cut

LENGTH = 400
GRAM = 32
# Anchors at this offset or later in their window have their left bytes in the key, others their right bytes.
SPLIT = (LENGTH - GRAM) // 2
# Multikey quicksort goes so many bytes beyond what a group shares before tries take over.
SHALLOW = 32
# Different runs of one key that one task sorts; beyond, windows are counted in a shuffle.
MOST_RUNS = 4000
# Ranges gathered before they leave the task.
CHUNK = 20_000

RUNS = "doc_id long, text_key long, anchor int, low short, high short, key long, whole long"
CONTEXTS = "key long, whole long, low short, high short, left binary, right binary"


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    low, high = start, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


class BlindTrie:
    """Sorts strings that share a long prefix by the bytes at which they part.

    A node is [depth, children by byte]; -1 stands for the end of a string. Going down looks
    at one byte per node only; one comparison with the leaf reached tells the true place.
    """

    def __init__(self, strings: list[bytes], first: int, depth: int) -> None:
        self.strings, self.depth = strings, depth
        self.root: list | int = first

    def add(self, i: int) -> None:
        text, strings = self.strings[i], self.strings
        node = self.root
        while isinstance(node, list):
            at, children = node
            byte = text[at] if at < len(text) else -1
            node = children.get(byte)
            if node is None:
                node = next(iter(children.values()))
        other = strings[node]
        common = common_prefix(text, other, min(self.depth, len(text), len(other)))
        mine = text[common] if common < len(text) else -1
        parent, byte, node = None, 0, self.root
        while isinstance(node, list) and node[0] < common:
            parent, byte = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][byte]
        if isinstance(node, list) and node[0] == common:
            # Only an end can be taken already; equal strings stand side by side.
            node[1][mine if mine not in node[1] else -2 - i] = i
            return
        theirs = other[common] if common < len(other) else -1
        new = [common, {theirs: node, (mine if mine != theirs else -2 - i): i}]
        if parent is None:
            self.root = new
        else:
            parent[1][byte] = new

    def walk(self) -> Iterator[tuple[int, int]]:
        """Strings in order, each with the length of the prefix it shares with the one before."""
        stack: list[tuple[object, int]] = [(self.root, -1)]
        while stack:
            node, shared = stack.pop()
            if not isinstance(node, list):
                yield node, shared
                continue
            depth, children = node
            order = sorted(children)
            for n, byte in reversed(list(enumerate(order))):
                stack.append((children[byte], shared if n == 0 else depth))


def deep_shallow_sort(strings: list[bytes], shared: int = 0) -> tuple[list[int], list[int]]:
    """Indices of ``strings`` in order, and common prefixes of each with the one before (0 for the first).

    All strings are known to share their first ``shared`` bytes.
    """
    order: list[int] = []
    prefixes: list[int] = []
    deep = shared + SHALLOW
    # (members, depth reached, prefix shared with what comes before)
    stack = [(list(range(len(strings))), shared, 0)]
    while stack:
        members, depth, before = stack.pop()
        if len(members) == 1:
            order.append(members[0])
            prefixes.append(before)
            continue
        if depth >= deep:
            trie = BlindTrie(strings, members[0], depth)
            for i in members[1:]:
                trie.add(i)
            for i, common in trie.walk():
                order.append(i)
                prefixes.append(before if common < 0 else common)
            continue
        # Characters of eight bytes; their common bytes are found where two parts meet.
        pivot = strings[members[len(members) // 2]][depth : depth + 8]
        less, same, more = [], [], []
        for i in members:
            character = strings[i][depth : depth + 8]
            (same if character == pivot else less if character < pivot else more).append(i)
        parts = [p for p in (less, same, more) if p]
        pushed = []
        for n, part in enumerate(parts):
            if n == 0:
                start = before
            else:
                # The largest of the part before and the smallest of this part share most.
                a = max(strings[i][depth : depth + 8] for i in parts[n - 1])
                b = min(strings[i][depth : depth + 8] for i in part)
                start = depth + common_prefix(a, b)
            if part is same and len(pivot) < 8:
                # All of these end here and are equal.
                pushed.append(("equal", part, depth + len(pivot), start))
            else:
                pushed.append(("sort", part, depth + 8 if part is same else depth, start))
        for kind, part, reached, start in reversed(pushed):
            if kind == "sort":
                stack.append((part, reached, start))
            else:
                stack.extend(([i], reached, reached) for i in part[:0:-1])
                stack.append(([part[0]], reached, start))
    return order, prefixes


def repeated_offsets(low: list[int], high: list[int], left: list[bytes], right: list[bytes], shared_left: int, shared_right: int) -> list[list[tuple[int, int]]]:
    """Per run, the ranges of offsets (first, last) whose windows another of the runs holds.

    ``left`` are the bytes before the anchors, reversed; ``right`` those from the anchors on.
    """
    n = len(low)
    by_right, after = deep_shallow_sort(right, shared_right)
    by_left, before = deep_shallow_sort(left, shared_left)
    right_rank, left_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    right_rank[by_right] = np.arange(n)
    left_rank[by_left] = np.arange(n)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n <= 6:
        for i in range(n):
            for j in range(i):
                a, b = sorted((int(right_rank[i]), int(right_rank[j])))
                c, d = sorted((int(left_rank[i]), int(left_rank[j])))
                first = max(LENGTH - min(after[a + 1 : b + 1]), low[i], low[j])
                last = min(min(before[c + 1 : d + 1]), high[i], high[j])
                if first <= last:
                    found[i].append((first, last))
                    found[j].append((first, last))
        return found
    lows, highs = np.array(low), np.array(high)
    after_, before_ = np.array(after), np.array(before)
    open_since = np.full(n, -1)
    for offset in range(min(low), max(high) + 2):
        # Runs that agree on the right side stand together in one order, on the left side in the other.
        right_group = np.cumsum(after_ < LENGTH - offset)[right_rank]
        left_group = np.cumsum(before_ < offset)[left_rank]
        inside = np.flatnonzero((lows <= offset) & (offset <= highs))
        _, which, count = np.unique(right_group[inside] * (n + 1) + left_group[inside], return_inverse=True, return_counts=True)
        twice = np.zeros(n, bool)
        twice[inside] = count[which] > 1
        for i in np.flatnonzero(~twice & (open_since >= 0)):
            found[i].append((int(open_since[i]), offset - 1))
            open_since[i] = -1
        open_since[twice & (open_since < 0)] = offset
    return found


def anchors(data: bytes, table: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of every run of windows with one anchor."""
    n = len(data)
    width = LENGTH - GRAM + 1
    values = table[np.frombuffer(data, np.uint8)]
    # Hash of each gram by doubling: 1, 2, 4, ... bytes.
    size, factor = 1, base
    with np.errstate(over="ignore"):
        while size < GRAM:
            values = values[: n - 2 * size + 1] * np.uint64(factor) + values[size:]
            factor = factor * factor % 2**64
            size *= 2
        values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    # Hash above, place below: the smallest is the first of the smallest hashes.
    marks = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    blocks = -(-len(marks) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(marks)] = marks
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    smallest = np.minimum(backward[:windows], forward[width - 1 : width - 1 + windows])
    place = (smallest & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    ends = np.r_[starts[1:], windows] - 1
    return place[starts], starts, ends


def window_runs(docs: DataFrame) -> DataFrame:
    """A row for each anchor and side: offsets low..high of the windows, key, hash of all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rng = np.random.default_rng(20240602)
        table = rng.integers(0, 2**64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
        hashed = xxhash.xxh3_64_intdigest
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(at, 500)
                ids, keys_of = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
                out: list[tuple] = []
                for doc_id, text_key_, text in zip(ids, keys_of, batch.column("text").to_pylist(), strict=True):
                    data = (text or "").encode()
                    if len(data) < LENGTH:
                        continue
                    places, firsts, lasts = anchors(data, table, base)
                    for a, first, last in zip(places.tolist(), firsts.tolist(), lasts.tolist(), strict=True):
                        low, high = a - last, a - first
                        if high >= SPLIT:
                            low_ = max(low, SPLIT)
                            key = hashed(data[a - SPLIT : a + GRAM], 1)
                            all_ = hashed(data[a - high : a - low_ + LENGTH], low_ << 10 | high)
                            out.append((doc_id, text_key_, a, low_, high, key, all_))
                        if low < SPLIT:
                            high_ = min(high, SPLIT - 1)
                            key = hashed(data[a : a + LENGTH - SPLIT + 1], 2)
                            all_ = hashed(data[a - high_ : a - low + LENGTH], low << 10 | high_)
                            out.append((doc_id, text_key_, a, low, high_, key, all_))
                columns = list(zip(*out, strict=True)) if out else [()] * 7
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16())
                arrays = [pa.array(c, t) for c, t in zip(columns[:5], types, strict=True)]
                arrays += [pa.array(np.array(c, np.uint64).view(np.int64)) for c in columns[5:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "anchor", "low", "high", "key", "whole"])

    return docs.mapInArrow(run, RUNS)


def _contexts(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The bytes left (reversed) and right of the anchors of ``runs``."""
    wanted = runs.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.collect_list(F.struct("key", "whole", "anchor", "low", "high")).alias("runs")
    )
    rows = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    # Of rows equal in id and text one is enough: their bytes are the same.
    rows = rows.select("text", "runs")

    names = ("key", "whole", "low", "high", "left", "right")
    types = (pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for text, runs_ in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data = text.encode()
                for r in runs_:
                    at, low, high = r["anchor"], r["low"], r["high"]
                    out.append((r["key"], r["whole"], low, high, data[at - high : at][::-1], data[at : at + LENGTH - low]))
                    if len(out) >= 2000:
                        yield flushed()
        yield flushed()

    return rows.mapInArrow(run, CONTEXTS)


def _sorted_ranges(contexts: DataFrame) -> DataFrame:
    """(key, whole, first, last) of offsets that repeat, by deep-shallow sorting within each key."""
    schema = "key long, whole long, first int, last int"

    def ranges(rows: list[dict]) -> list[tuple[int, int, int, int]]:
        out = []
        # A key is a hash; what it stands for is compared as it is.
        late = rows[0]["low"] >= SPLIT
        left, right = (SPLIT, GRAM) if late else (0, LENGTH - SPLIT + 1)
        alike: dict[tuple[bytes, bytes], dict[int, dict]] = {}
        for r in rows:
            alike.setdefault((r["left"][:left], r["right"][:right]), {})[r["whole"]] = r
        for members in alike.values():
            if len(members) > 1:
                some = list(members.values())
                columns = [[r[c] for r in some] for c in ("low", "high", "left", "right")]
                found = repeated_offsets(*columns, left, right)
                out += [(r["key"], r["whole"], a, b) for r, spans in zip(some, found, strict=True) for a, b in spans]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        out: list[tuple[int, int, int, int]] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            out.clear()
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["key", "whole", "first", "last"])

        for batch in batches:
            for row in batch.to_pylist():
                if group and row["key"] != group[0]["key"]:
                    out.extend(ranges(group))
                    group = []
                group.append(row)
            if len(out) > CHUNK:
                yield flushed()
        if group:
            out.extend(ranges(group))
        yield flushed()

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _counted_ranges(contexts: DataFrame) -> DataFrame:
    """The same for keys with very many runs: every window is hashed and counted."""
    schema = "key long, whole long, at int, h1 long, h2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for row in batch.to_pylist():
                data = row["left"][::-1] + row["right"]
                offsets = range(row["low"], row["high"] + 1)
                digests = b"".join(
                    xxhash.xxh3_128_digest(data[row["high"] - o : row["high"] - o + LENGTH], o) for o in offsets
                )
                both = np.frombuffer(digests, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["key"]] * len(offsets), pa.int64()),
                        pa.array([row["whole"]] * len(offsets), pa.int64()),
                        pa.array(list(offsets), pa.int32()),
                        pa.array(both[::2]),
                        pa.array(both[1::2]),
                    ],
                    names=["key", "whole", "at", "h1", "h2"],
                )

    windows = contexts.mapInArrow(run, schema).distinct()
    # Offsets are part of the hash and keys of what they stand for, so equal windows are of different runs.
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    found = windows.join(twice, ["h1", "h2"], "left_semi")
    return found.select("key", "whole", F.col("at").alias("first"), F.col("at").alias("last"))


def repeated_bytes(docs: DataFrame, most_runs: int = MOST_RUNS) -> DataFrame:
    """(doc_id, text_key, spans) of the rows that hold a string of 400 bytes found elsewhere.

    ``docs`` has doc_id, text and text_key. A span is the first byte of a range to remove and
    the byte after it; spans may overlap.
    """
    runs = window_runs(docs.select("doc_id", "text", "text_key"))
    runs = cut(runs, "runs")
    shared = runs.groupBy("key").agg(F.count("*").alias("n"), F.min("whole").alias("_a"), F.max("whole").alias("_b"))
    shared = shared.where("n > 1").select(F.col("key").alias("_key"), (F.col("_a") != F.col("_b")).alias("differ"))
    # Written, as Spark splits a crowded key of a join only if neither side was grouped for it.
    shared = cut(shared, "shared-keys")
    suspects = cut(runs.join(shared, F.col("key") == F.col("_key")).drop("_key"), "suspects")

    differing = suspects.where("differ")
    first = differing.groupBy("key", "whole").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key", "anchor", "low", "high")).alias("one")
    )
    first = cut(first.select("key", "whole", "copies", "one.*"), "different-runs")
    crowded = first.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most_runs).select("key")
    crowded = cut(crowded, "crowded-keys")
    contexts = cut(_contexts(docs, first), "contexts")
    ranges = _sorted_ranges(contexts.join(crowded, "key", "left_anti")).unionByName(
        _counted_ranges(contexts.join(crowded, "key", "left_semi"))
    )
    # Runs that stand only once; the others repeat wholly.
    ranges = cut(ranges, "ranges")
    single = first.where("copies = 1").join(ranges, ["key", "whole"]).select("doc_id", "text_key", "anchor", "first", "last")
    twice = differing.join(
        first.where("copies > 1").select(F.col("key").alias("_k"), F.col("whole").alias("_w")),
        (F.col("key") == F.col("_k")) & (F.col("whole") == F.col("_w")),
        "left_semi",
    ).unionByName(suspects.where("not differ"))
    all_ranges = single.unionByName(
        twice.select("doc_id", "text_key", "anchor", F.col("low").cast("int").alias("first"), F.col("high").cast("int").alias("last"))
    )
    spans = F.struct((F.col("anchor") - F.col("last")).alias("start"), (F.col("anchor") - F.col("first") + LENGTH).alias("end"))
    return all_ranges.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(spans)).alias("spans"))


def _with_spans(docs: DataFrame, most_runs: int) -> DataFrame:
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    spans = cut(repeated_bytes(keyed, most_runs), "spans").withColumnsRenamed({"doc_id": "_id", "text_key": "_text_key", "spans": "_spans"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key(F.col("text")) == F.col("_text_key"))
    return docs.join(spans, same, "left").select(*docs.columns, "_spans")


def merged_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal ranges of spans in order of their starts; ranges that touch are one."""
    found: list[tuple[int, int]] = []
    for span in spans or ():
        if found and span["start"] <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], span["end"]))
        else:
            found.append((span["start"], span["end"]))
    return found


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    return b"".join([*kept, data[at:]])


def byte_report(docs: DataFrame, most_runs: int = MOST_RUNS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. Texts under 400 bytes lose nothing. Rows equal in id and text each
    count as an occurrence, so both lose what they share.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    rows = _with_spans(docs.select("doc_id", "text"), most_runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            sizes, removed, counts, digests = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                data = (text or "").encode()
                spans = merged_spans(found)
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in spans))
                counts.append(len(spans))
                digests.append(hashlib.sha256(without(data, spans)).hexdigest())
            longs = [pa.array(c, pa.int64()) for c in (sizes, removed, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *longs, pa.array(digests, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return rows.mapInArrow(run, schema)


def drop_repeated_bytes(docs: DataFrame, most_runs: int = MOST_RUNS) -> DataFrame:
    """``docs`` with repeated strings of 400 bytes cut out of the text; all columns stay.

    A cut may fall inside a character; its bytes that are left over are dropped. Null texts stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if text is None else without(text.encode(), merged_spans(found)).decode(errors="ignore")
                for text, found in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)
            ]
            names = [c for c in batch.schema.names if c != "_spans"]
            columns = [pa.array(texts, batch.column(c).type) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    packed, back = apart(docs, ("doc_id", "text"))
    return back(_with_spans(packed, most_runs).mapInArrow(run, packed.schema))
