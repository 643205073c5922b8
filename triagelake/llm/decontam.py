"""Benchmark decontamination: remove from training text what a benchmark holds.

The windows of a benchmark are its runs of ten normalised words; an item with fewer words
is one window. A hash set of them goes to every task as a broadcast, each document's
windows are looked up in it while it is scanned, and what is found is checked word by word.
Which items hold a window stays out of the broadcast: a window bears the key of its set of
items, and the sets are looked up once per combination of them, after the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.binding import bind
from triagelake.llm.words import apart, lower_ascii, plain_words, text_key, whole, windows
from triagelake.session import cut

WINDOW = 10
# Windows of up to so many bytes are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 128 << 20


def folded(words: Column) -> Column:
    """Words equal but for the case of A-Z get equal forms; the exact comparison comes later."""
    return F.transform(words, lambda w: F.lower(w))


def window_items(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct n (words), words (exact) of the windows, with every item_id that holds them."""
    items = benchmark.select("item_id", plain_words(lower_ascii(whole(F.col("text")))).alias("_w"))
    items = items.withColumn("n", F.least(F.size("_w"), F.lit(size))).where("n > 0")
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("n") + 1), lambda i: F.slice(F.col("_w"), i, F.col("n")))
    return items.select("item_id", "n", F.explode(runs).alias("words")).distinct()


def benchmark_windows(held: DataFrame) -> DataFrame:
    """Distinct windows of ``window_items``: n, hash of the folded words, words, items_key.

    Windows of the same items have the same ``items_key``. It is made of sums, so that no
    window gathers its items, however many there are.
    """
    sums = [F.coalesce(F.bit_xor(F.xxhash64(F.lit(i), "item_id")), F.lit(0)) for i in range(2)]
    found = held.groupBy("n", "words").agg(F.xxhash64(F.count("item_id"), *sums).alias("items_key"))
    return found.withColumn("hash", F.xxhash64(folded(F.col("words"))))


def item_sets(held: DataFrame, known: DataFrame) -> DataFrame:
    """items_key and every item_id of that set, read from one window of each set."""
    window = F.struct("n", "words")
    one = known.groupBy("items_key").agg(F.min_by(window, F.struct("hash", "words")).alias("_window"))
    same = (F.col("n") == F.col("_window.n")) & (F.col("words") == F.col("_window.words"))
    return one.join(held.where("item_id is not null"), same).select("items_key", "item_id")


def bytes_of(known: DataFrame) -> int:
    """About what the windows take as rows in memory."""
    words = F.octet_length(F.array_join("words", "")) + 24 * F.size("words") + 96
    return known.agg(F.sum(words.cast("long"))).first()[0] or 0


def find_hits(docs: DataFrame, known: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document that may hold ``known`` windows: doc_id, key of its text, hits (at, words, items_key).

    ``at`` counts words from 0. Hits are by hash and still to be verified. They are kept per
    document, whose length bounds them.
    """
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # at most ``size`` numbers
    if not lengths:
        lengths = [size]
    side = F.broadcast(known) if bytes_of(known) <= BROADCAST_BYTES else known
    words = folded(plain_words(F.col("text")))

    def all_windows(w: Column) -> Column:
        return F.array(*[windows(w, n, F.xxhash64) for n in lengths])

    found = (
        docs.select(F.col("doc_id"), text_key(F.col("text")).alias("_key"), bind(words, all_windows).alias("_all"))
        .select("doc_id", "_key", F.posexplode("_all").alias("_length", "_each"))
        if len(lengths) > 1
        else docs.select(
            F.col("doc_id"),
            text_key(F.col("text")).alias("_key"),
            F.lit(0).alias("_length"),
            bind(words, lambda w: windows(w, lengths[0], F.xxhash64)).alias("_each"),
        )
    )
    spread = found.select("doc_id", "_key", "_length", F.posexplode("_each").alias("at", "hash"))
    numbers = F.array(*[F.lit(n) for n in lengths])
    hits = spread.join(side, "hash").where(F.get(numbers, F.col("_length")) == F.col("n"))
    return hits.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("at", "words", "items_key")).alias("hits"))


def with_hits(docs: DataFrame, known: DataFrame, columns: list[str], size: int = WINDOW) -> DataFrame:
    """``columns`` of every row, its exact words and its verified hits on ``known`` windows, sorted by place.

    Rows that share an id are told apart by their texts; rows equal in both share their hits.
    """
    found = cut(find_hits(docs, known, size), "benchmark-hits").select(
        F.col("doc_id").alias("_hit_id"), F.col("_key").alias("_hit_key"), F.col("hits").alias("_hits")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (text_key(F.col("text")) == F.col("_hit_key"))
    rows = docs.join(found, same, "left")
    # Only rows with hits need their words in lower case.
    words = plain_words(F.when(F.col("_hits").isNotNull(), lower_ascii(whole(F.col("text")))).otherwise(F.col("text")))
    rows = rows.select(*columns, "_hits", words.alias("_words"))
    right = F.filter(
        F.col("_hits"), lambda h: F.slice(F.col("_words"), h["at"] + 1, F.size(h["words"])) == h["words"]
    )
    spans = F.coalesce(F.sort_array(right), F.expr("array()").cast(rows.schema["_hits"].dataType))
    return rows.withColumn("_hits", spans)


def hit_words(hits: Column) -> Column:
    """Words inside any of the hits, which are sorted by place."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(state: Column, h: Column) -> Column:
        end = h["at"] + F.size(h["words"])
        new = F.greatest(F.lit(0), end - F.greatest(state["end"], h["at"]))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["total"] + new).alias("total"))

    return F.aggregate(hits, start, add, lambda s: s["total"])


def contamination_report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row: n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words, an empty benchmark no windows; neither is ever hit.
    """
    held = cut(window_items(benchmark, size), "benchmark-items")
    known = cut(benchmark_windows(held), "benchmark-windows")
    rows = with_hits(docs, known, ["doc_id"], size).select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        hit_words(F.col("_hits")).cast("long").alias("n_hit"),
        F.sort_array(F.array_distinct(F.transform("_hits", lambda h: h["items_key"]))).alias("_sets"),
    )
    rows = cut(rows, "contamination")
    # Documents that hold the same passages ask for the same sets of items: once for all of them.
    asked = rows.where("n_hit > 0").select(F.col("_sets").alias("_asked")).distinct()
    each = asked.select("_asked", F.explode("_asked").alias("items_key")).join(item_sets(held, known), "items_key")
    names = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    named = each.groupBy("_asked").agg(names.alias("_names"))
    none = F.array().cast("array<string>")
    hit = rows.where("n_hit > 0").join(named, F.col("_sets") == F.col("_asked"), "left")
    both = hit.select("doc_id", "n_words", "n_hit", F.coalesce("_names", none).alias("_names")).union(
        rows.where("n_hit = 0").select("doc_id", "n_words", "n_hit", none)
    )
    return both.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("_names").cast("long").alias("n_items"),
        F.sha2(F.array_join("_names", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", size: int = WINDOW) -> DataFrame:
    """``docs`` without what the benchmark holds; all columns stay.

    ``remove="documents"`` drops every row with a hit. ``remove="spans"`` cuts the words of
    the hits out of the text, each with the characters up to the next word.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    packed, back = apart(docs, ("doc_id", "text"))
    known = cut(benchmark_windows(window_items(benchmark, size)), "benchmark-windows")
    rows = with_hits(packed, known, packed.columns, size)
    if remove == "documents":
        return back(rows.where(F.size("_hits") == 0))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"({word}{gap}*)"), F.lit(1))
    head = F.regexp_extract(F.col("text"), f"^({gap}*)", 1)
    # Places inside hits, as one array; ``_hits`` is bounded by the document.
    places = F.array_distinct(
        F.flatten(F.transform("_hits", lambda h: F.sequence(h["at"], h["at"] + F.size(h["words"]) - 1)))
    )
    whole_places = F.sequence(F.lit(0), F.size("_words") - 1)
    kept = bind(F.array_except(whole_places, places), lambda at: bind(pieces, lambda p: F.transform(at, lambda i: F.get(p, i))))
    clean = F.concat(head, F.array_join(kept, ""))
    return back(rows.withColumn("text", F.when(F.size("_hits") > 0, clean).otherwise(F.col("text"))))
