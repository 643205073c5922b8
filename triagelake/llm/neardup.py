"""MinHash near-duplicates with b-bit signatures.

1. One pass over the texts gives, per document, the size and a fingerprint of its set of
   five-word shingles, band keys made of whole minima, and a signature that keeps the low
   two bits of each minimum, packed.
2. Documents with one fingerprint form a class; only its smallest id goes on, so thousands
   of copies cost one row per task.
3. Classes that share a band key are candidates. First every class of a bucket is held
   against the smallest one of the bucket: pairs grow with the rows, not with their square.
   What links is merged. While buckets hold many pairs across components, they are held
   against other members of theirs in turn, which merges a crowd of near copies quickly.
   Pairs across components that are left are then formed, inside the join, where a bucket has
   few; documents of crowded buckets are compared by blocks, which return links alone.
4. Signatures are compared by counting equal two-bit cells, corrected for cells that agree
   by chance. Pairs far under the threshold are dropped, the rest is decided on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.components import components
from triagelake.llm.words import lower_ascii, spaced_words, whole
from triagelake.functions.binding import bind
from triagelake.session import cut

SHINGLE = 5
# Links: PERCENT * union <= 100 * intersection.
PERCENT = 75
# 48 bands of 5 minima: a pair at the threshold is missed about twice in a million, a
# pair at 0.8 five times in a thousand million.
BANDS, ROWS = 48, 5
MINIMA = BANDS * ROWS
BITS = 2
LANES = 8  # longs that hold MINIMA cells of BITS bits
# Estimates have a standard deviation of about 0.034 at the threshold; six of them below it a pair is dropped.
LEAST_ESTIMATE = 0.55

# Buckets with more pairs across components than so many times their rows are crowded: further stars
# come first, then comparison by blocks.
FEW_PAIRS = 2.0
# Stars in each bucket and turn.
STARS = 8
# Documents of a crowd that a task compares with as many others.
CROWD_BLOCK = 128

SCHEMA = "doc_id long, n_shingles long, f1 long, f2 long, sig array<long>, bands array<long>"


def constants() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20240601)
    flips = rng.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32)
    factors = (rng.integers(0, 2**32, MINIMA, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    of_words = rng.integers(0, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
    of_bands = rng.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
    names = rng.integers(0, 2**64, BANDS, dtype=np.uint64)
    return flips, factors, of_words, of_bands, names


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, of_words: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty without a word."""
    import xxhash

    # bytes.lower and bytes.split know ASCII only: A-Z, and space, tab to carriage return.
    words = text.encode().lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    width = min(SHINGLE, n)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total += hashes[j : n - width + 1 + j] * of_words[j]
    return np.unique(mixed(total))


def minima(hashes: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest image of the set under each of the permutations of 32-bit values."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(high), 1024):
        part = high[None, start : start + 1024] ^ flips[:, None]
        part *= factors[:, None]
        part ^= part >> np.uint32(15)
        np.minimum(low, part.min(axis=1), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 32 cells to a long."""
    cells = np.zeros(LANES * 32, np.uint64)
    cells[:MINIMA] = low & np.uint32(2**BITS - 1)
    shifts = np.arange(32, dtype=np.uint64) * np.uint64(BITS)
    return (cells.reshape(LANES, 32) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """Shingle count, fingerprint, packed signature and band keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        flips, factors, of_words, of_bands, names = constants()
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 1000):
                batch = whole_batch.slice(at, 1000)
                out: tuple[list, ...] = ([], [], [], [], [])
                for text in batch.column("text").to_pylist():
                    hashes = shingle_hashes(text or "", of_words)
                    if len(hashes) == 0:
                        row = (0, None, None, None, None)
                    else:
                        low = minima(hashes, flips, factors)
                        keys = (low.reshape(BANDS, ROWS).astype(np.uint64) * of_bands).sum(axis=1, dtype=np.uint64)
                        digest = xxhash.xxh3_128_digest(hashes.tobytes())
                        f1, f2 = np.frombuffer(digest, np.int64).tolist()
                        row = (len(hashes), f1, f2, packed(low), mixed(keys ^ names).view(np.int64))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array(out[0], pa.int64()),
                        pa.array(out[1], pa.int64()),
                        pa.array(out[2], pa.int64()),
                        pa.array(out[3], longs),
                        pa.array(out[4], longs),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "sig", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures, corrected for cells that agree by chance."""
    differing = F.lit(0)
    for lane in range(LANES):
        x = F.get(a, F.lit(lane)).bitwiseXOR(F.get(b, F.lit(lane)))
        cells = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differing = differing + F.bit_count(cells)
    chance = 1 / 2**BITS
    return ((1 - differing / MINIMA) - chance) / (1 - chance)


def alike_in_size(a: Column, b: Column) -> Column:
    """Sets whose sizes allow the threshold."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) with the distinct shingles of each row as 64-bit hashes."""

    def shingles(w: Column) -> Column:
        width = F.least(F.lit(SHINGLE), F.size(w))
        return F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(F.slice(w, i, width)))
        )

    words = spaced_words(lower_ascii(whole(F.col("text"))))
    return docs.select("doc_id", bind(words, shingles).alias("shingles"))


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sizes and signatures leave a link possible."""
    sizes = classes.select(F.col("node").alias("_n"), F.col("n_shingles").alias("size"), "sig")
    near = (
        pairs.join(sizes.withColumnsRenamed({"_n": "_u", "size": "nu", "sig": "su"}), F.col("u") == F.col("_u"))
        .join(sizes.withColumnsRenamed({"_n": "_v", "size": "nv", "sig": "sv"}), F.col("v") == F.col("_v"))
        .where(alike_in_size(F.col("nu"), F.col("nv")) & (estimate(F.col("su"), F.col("sv")) >= LEAST_ESTIMATE))
    )
    return cut(near.select("u", "v"), "near-pairs")


def sets_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, shingles) of ``nodes`` (doc_id). Of an id on several rows, each set counts."""
    wanted = cut(nodes.distinct(), "near-nodes")
    found = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    return cut(shingle_sets(found).distinct(), "near-sets")


def confirmed(near: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, on full sets."""
    both = near.join(sets.withColumnsRenamed({"doc_id": "_v", "shingles": "right"}), F.col("v") == F.col("_v")).join(
        sets.withColumnsRenamed({"doc_id": "_u", "shingles": "left"}), F.col("u") == F.col("_u")
    )
    common = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - common
    return cut(both.where(100 * common >= PERCENT * union).select("u", "v").distinct(), "near-links")


def common_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    lengths = [len(x) for x in (*left, *right)]
    values, place, held = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(lengths)), lengths)
    shared = held[place] > 1
    # Shingles of one set alone add nothing; the others become columns, so many at a time.
    column = (np.cumsum(held > 1) - 1)[place]
    row, column = row[shared], column[shared]
    total = np.zeros((len(left), len(right)))
    for start in range(0, int(column.max()) + 1 if len(column) else 0, width):
        here = (column >= start) & (column < start + width)
        marks = np.zeros((len(lengths), width), np.float32)
        marks[row[here], column[here] - start] = 1
        total += marks[: len(left)] @ marks[len(left) :].T
    return total


def crowd_links(crowd: DataFrame) -> DataFrame:
    """Links (u, v) across components within each crowd, by pairs of bounded blocks.

    ``crowd`` has crowd, node, component, sig and shingles. A task holds two blocks and
    returns links alone.
    """
    sizes = crowd.groupBy(F.col("crowd").alias("_crowd")).agg(F.ceil(F.count("*") / CROWD_BLOCK).cast("int").alias("blocks"))
    rows = crowd.join(cut(sizes, "crowd-sizes"), F.col("crowd") == F.col("_crowd")).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int")
    )
    fields = ["node", "component", "sig", "shingles"]
    first = rows.select("crowd", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), *fields)
    second = rows.select(
        F.col("crowd").alias("r_crowd"),
        F.explode(F.sequence(F.lit(0), F.col("block"))).alias("r_i"),
        F.col("block").alias("r_j"),
        *[F.col(c).alias(f"r_{c}") for c in fields],
    )

    def link(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        b = b.rename_columns([c.removeprefix("r_") for c in b.column_names])
        nodes = [t.column("node").to_numpy() for t in (a, b)]
        parts = [t.column("component").to_numpy() for t in (a, b)]
        sets = [[np.array(x, np.int64) for x in t.column("shingles").to_pylist()] for t in (a, b)]
        sigs = [np.array(t.column("sig").to_pylist(), np.int64).view(np.uint64) for t in (a, b)]
        x = sigs[0][:, None, :] ^ sigs[1][None, :, :]
        differing = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=2)
        chance = 1 / 2**BITS
        near = ((1 - differing / MINIMA) - chance) / (1 - chance) >= LEAST_ESTIMATE
        near &= parts[0][:, None] != parts[1][None, :]
        rows_, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        found: list[tuple[int, int]] = []
        if len(rows_):
            some = [sets[0][r] for r in rows_], [sets[1][c] for c in columns]
            common = common_counts(*some)
            n = [np.array([len(x) for x in part]) for part in some]
            linked = 100 * common >= PERCENT * (n[0][:, None] + n[1][None, :] - common)
            linked &= near[np.ix_(rows_, columns)]
            found = [(int(nodes[0][rows_[r]]), int(nodes[1][columns[c]])) for r, c in np.argwhere(linked)]
        return pa.table({"u": pa.array([p[0] for p in found], pa.int64()), "v": pa.array([p[1] for p in found], pa.int64())})

    grouped = first.groupBy("crowd", "i", "j").cogroup(second.groupBy("r_crowd", "r_i", "r_j"))
    return grouped.applyInArrow(link, "u long, v long")


def open_buckets(shared: DataFrame, merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, node, component) of buckets that hold several components, and per such bucket
    its rows and the pairs across components."""
    merged = merged.select(F.col("node").alias("_node"), "component")
    placed = shared.join(merged, F.col("node") == F.col("_node"), "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    placed = cut(placed, "placed")
    sizes = placed.groupBy("key", "component").agg(F.count("*").cast("double").alias("n"))
    sizes = sizes.groupBy(F.col("key").alias("_key")).agg(
        F.count("*").alias("parts"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("inside")
    )
    # Two members: the first star has tried their only pair.
    sizes = sizes.where("parts > 1 and rows > 2").select("_key", "rows", ((F.col("rows") * F.col("rows") - F.col("inside")) / 2).alias("across"))
    sizes = cut(sizes, "open-keys")
    rows = placed.join(sizes.select("_key"), F.col("key") == F.col("_key"), "left_semi")
    return cut(rows, "open-buckets"), sizes


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents link at 100 * intersection >= 75 * union of their shingle sets; a component is
    named by its smallest id, which is the one kept. Fewer words than a shingle form one
    shingle; a null or empty text has none and links with nothing. Rows that share an id are
    one document, but a row without words stands alone. A null id takes no part: component null, kept. Extra columns are left out.
    """
    table = cut(signatures(docs), "signatures")
    known = table.where("doc_id is not null and n_shingles > 0")
    firsts = known.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"))
    # Grouped sides are written before they are joined: Spark splits a crowded key of a join
    # only if neither side was grouped for it.
    firsts = cut(firsts.select(F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), "node"), "firsts")
    same_set = (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2"))
    members = cut(known.join(firsts, same_set).select("doc_id", "n_shingles", "node", "f1", "f2"), "members")
    heads = members.where("doc_id = node").select(F.col("node").alias("_node"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2"))
    classes = known.join(heads.distinct(), (F.col("doc_id") == F.col("_node")) & same_set, "left_semi")
    classes = cut(classes.select(F.col("doc_id").alias("node"), "n_shingles", "sig", "bands").distinct(), "heads")
    # An id on rows of several classes joins them.
    several = members.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("_v")).where("u < _v")
    several = members.join(several.select(F.col("doc_id").alias("_id"), "u"), F.col("doc_id") == F.col("_id"))
    several = several.select("u", F.col("node").alias("v"))

    banded = classes.select("node", F.explode("bands").alias("key"))
    centers = banded.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("_last")).where("center < _last")
    centers = cut(centers.withColumnRenamed("key", "_key"), "centers")
    shared = cut(
        banded.join(centers, F.col("key") == F.col("_key")).select("key", "node", "center"),
        "buckets",
    )
    stars = shared.where("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct()
    near = promising(stars, classes)
    sets = sets_of(near.select(F.col("u").alias("doc_id")).union(near.select("v")), docs)
    merged = cut(components(confirmed(near, sets)), "components")

    rest, sizes = open_buckets(shared, merged)
    sets = sets_of(rest.select(F.col("node").alias("doc_id")), docs)
    before, turn = float("inf"), 0
    while True:
        totals = sizes.agg(F.sum("rows").alias("rows"), F.sum("across").alias("across")).first()
        left = totals["across"] or 0.0
        if left <= FEW_PAIRS * (totals["rows"] or 0.0) or left > 0.8 * before:
            break
        # Many pairs: stars around a few members of each bucket, in the order of hashes that change
        # by the turn. Links of a crowd merge it in a turn or two, with a few pairs per row.
        orders = [F.struct(F.xxhash64(F.lit(turn * STARS + i), "node").alias("h"), "node", "component") for i in range(STARS)]
        chosen = rest.groupBy(F.col("key").alias("_key")).agg(F.array(*[F.min(order) for order in orders]).alias("centers"))
        # Buckets of a crowd mostly choose the same stars: a row gathers those of its buckets, and meets each once.
        named_by = F.transform("centers", lambda c: F.struct(c["node"].alias("node"), c["component"].alias("component")))
        chosen = cut(chosen.select("_key", F.array_distinct(named_by).alias("centers")), "centers")
        met = rest.join(chosen, F.col("key") == F.col("_key"))
        met = met.withColumn("centers", F.filter("centers", lambda c: c["component"] != F.col("component"))).where(F.size("centers") > 0)
        met = met.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("centers"))).alias("centers"))  # at most STARS a band
        tries = met.select("node", F.explode("centers").alias("center"))
        tries = tries.select(F.least("node", "center.node").alias("u"), F.greatest("node", "center.node").alias("v")).distinct()
        known = merged.select(F.col("component").alias("u"), F.col("node").alias("v"))
        merged = cut(components(confirmed(promising(tries, classes), sets).unionByName(known)), "components")
        rest, sizes = open_buckets(rest.select("key", "node"), merged)
        before, turn = left, turn + 1

    # What is left: pairs of a bucket where they are few. Crowded buckets that will not merge hold
    # documents that share much but too little; those that hang together are compared by blocks.
    few = F.col("across") <= FEW_PAIRS * F.col("rows")
    detail = classes.select(F.col("node").alias("_node"), "n_shingles", "sig")
    one = rest.join(sizes.where(few), F.col("key") == F.col("_key"), "left_semi").join(detail, F.col("node") == F.col("_node"))
    one = cut(one.drop("_node"), "open-details")
    other = one.select(*[F.col(c).alias(f"r_{c}") for c in one.columns])
    pairs = one.join(
        other,
        (F.col("key") == F.col("r_key"))
        & (F.col("node") < F.col("r_node"))
        & (F.col("component") != F.col("r_component"))
        & alike_in_size(F.col("n_shingles"), F.col("r_n_shingles"))
        & (estimate(F.col("sig"), F.col("r_sig")) >= LEAST_ESTIMATE),
    ).select(F.col("node").alias("u"), F.col("r_node").alias("v"))
    pairs = cut(pairs.distinct().join(stars, ["u", "v"], "left_anti"), "near-pairs")
    links = merged.select(F.col("component").alias("u"), F.col("node").alias("v")).unionByName(confirmed(pairs, sets))
    crowded = cut(rest.join(sizes.where(~few), F.col("key") == F.col("_key"), "left_semi"), "crowded-buckets")
    if not crowded.isEmpty():
        heads_of = cut(crowded.groupBy(F.col("key").alias("_key")).agg(F.min("node").alias("u")), "bucket-heads")
        hangs = crowded.join(heads_of, F.col("key") == F.col("_key")).select("u", F.col("node").alias("v"))
        crowds = cut(components(hangs), "crowds").select(F.col("node").alias("_in"), F.col("component").alias("crowd"))
        members_of = crowded.select("node", "component").distinct().join(crowds, F.col("node") == F.col("_in"))
        members_of = members_of.join(detail.select("_node", "sig"), F.col("node") == F.col("_node"))
        members_of = members_of.join(sets, F.col("node") == F.col("doc_id")).select("crowd", "node", "component", "sig", "shingles")
        links = links.unionByName(cut(crowd_links(cut(members_of, "crowd-rows")), "crowd-links"))

    named = cut(components(links.unionByName(several)), "components")
    named = named.withColumnsRenamed({"node": "_node", "component": "_component"})
    linked = members.join(named, F.col("node") == F.col("_node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("_component", "node").alias("component_id")
    )
    alone = table.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component; all columns stay.

    Rows with a null id and documents without words stay. Of rows that share the kept id
    all stay.
    """
    gone = cut(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
