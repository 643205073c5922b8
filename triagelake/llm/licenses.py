"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A block is a line, or a window of words over line ends. It matches a template when it holds
at least ``CONTAINED`` of the template's distinct words. Words that templates know are ordered by how many
texts of the corpus hold them, rarest first. A block that matches shares one of the template's first
``size - needed + 1`` words in that order (prefix filter) and has at least ``needed`` of
the templates' words (length filter); where the first shared word stands in both bounds
what they can still share (positional filter). What passes is counted in full.

Windows are twice as long as their template and start every half of it, so a notice with up
to half as many words between its own falls into one whole. Whole texts pass the same filters
and a count first; only those that hold enough of a template's words anywhere are cut into blocks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.binding import bind
from triagelake.llm.notices import NOTICES, TELLING, VERSIONS
from triagelake.llm.words import PUNCTUATION, UPPER, lower_ascii, plain_words, text_key, whole
from triagelake.session import cut

# Phrase and label of the base scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_LOWER = str.maketrans(UPPER, UPPER.lower())

# Notices as texts usually state them, with labels; those of ``NOTICES`` in their licences' own words.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    *NOTICES,
)
CONTAINED = 0.9
# Templates are a parameter that goes to every task; more words than this are refused.
MAX_TEMPLATE_WORDS = 20_000


def phrase_starts(words: Column, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand one after the other."""
    parts = phrase.split()

    def all_fit(i: Column) -> Column:
        fits = F.lit(True)
        for k, part in enumerate(parts):
            fits = fits & (F.get(words, i + k) == part)
        return fits

    last = F.size(words) - len(parts)
    return F.when(last < 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), last), all_fit))


def phrase_hits(text: Column, phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """Array of (at, label) of all phrases in the text, by place."""

    def search(words: Column) -> Column:
        def labelled(phrase: str, label: str) -> Column:
            return F.transform(phrase_starts(words, phrase), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

        return F.sort_array(F.concat(*[labelled(*each) for each in phrases]))

    # Texts without any of the last words hold no phrase; they are not cut into words.
    ends = "|".join(sorted({p.split()[-1] for p, _ in phrases}))
    none = F.array().cast("array<struct<at:int,label:string>>")
    return F.when(whole(text).rlike(f"(?i){ends}"), bind(plain_words(lower_ascii(whole(text))), search)).otherwise(none)


def _sequences(templates: Sequence[tuple[str, str]]) -> list[tuple[int, str, list[str]]]:
    """(number, label, words in order) of the templates that have words."""
    found = []
    for i, (label, text) in enumerate(templates):
        words = [w for w in re.split(PUNCTUATION, text.translate(_LOWER)) if w]
        if words:
            found.append((i, label, words))
    return found


def joined_words(phrase: str | None) -> str | None:
    """The words of a phrase as they stand in joined blocks."""
    return phrase and " " + " ".join(w for w in re.split(PUNCTUATION, phrase.translate(_LOWER)) if w) + " "


def notice_matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """Texts and the labels of templates that one of their blocks matches: doc_id, _key (of the text), label, score.

    Blocks are the lines, and windows of words over line ends. ``score`` is the largest share
    of a template with that label that a matching block holds. Of a label in ``TELLING`` or
    ``VERSIONS`` the block must hold those words one after the other, too.
    """
    spark = docs.sparkSession
    sets = _sequences(templates)
    vocabulary = sorted({w for _, _, words in sets for w in words})
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} distinct words")
    if not sets:
        return spark.createDataFrame([], "doc_id long, _key long, label string, score double")

    held = F.array_distinct(F.filter(plain_words(lower_ascii(whole(F.col("text")))), lambda w: w.isin(vocabulary)))
    texts = docs.select("doc_id", "text", held.alias("held"))
    counted = texts.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    frequency = {r["word"]: r["n"] for r in counted}  # at most one row per word of the templates
    ranked = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ranked)}
    index = []
    for _, label, words in sets:
        distinct = sorted(set(words), key=rank.__getitem__)
        needed = math.ceil(contained * len(distinct) - 1e-9)
        prefix = distinct[: len(distinct) - needed + 1]
        runs = [r for r in (joined_words(TELLING.get(label)), joined_words(VERSIONS.get(label))) if r]
        index += [(word, label, distinct, prefix, needed, len(words), runs) for word in prefix]
    side = F.broadcast(
        spark.createDataFrame(
            index, "word string, label string, words array<string>, prefix array<string>, needed int, length int, runs array<string>"
        )
    )
    first = sorted({row[0] for row in index})

    def may_match(held: Column) -> Column:
        """Length, prefix and positional filters for words in the order of ranks."""
        place = F.array_position("words", F.get(F.array_intersect("prefix", held), F.lit(0)))
        at = F.array_position(held, F.get(F.array_intersect("prefix", held), F.lit(0)))
        left = F.least(F.size("words") - place, F.size(held) - at) + 1
        return (F.size(held) >= F.col("needed")) & F.arrays_overlap("prefix", held) & (left >= F.col("needed"))

    # The order is that of the first array.
    asked = texts.where(F.arrays_overlap("held", F.lit(first))).withColumn("held", F.array_intersect(F.lit(ranked), "held"))
    asked = asked.select("doc_id", "text", "held", F.explode(F.filter("held", lambda w: w.isin(first))).alias("word"))
    # Each text and template meet at the first word of the prefix that the text holds.
    passed = (
        asked.join(side, "word")
        .where(F.get(F.array_intersect("prefix", "held"), F.lit(0)) == F.col("word"))
        .where(may_match(F.col("held")))
        .where(F.size(F.array_intersect("held", "words")) >= F.col("needed"))
    )

    def shared(block: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(block, " "), F.lit(" "))
        tells = F.forall("runs", lambda r: joined.contains(r))

        def count(known: Column) -> Column:
            return F.when(may_match(known) & tells, F.size(F.array_intersect(known, F.col("words")))).otherwise(0)

        return bind(F.array_intersect("held", block), count)

    stride = F.greatest(F.lit(1), F.floor(F.col("length") / 2).cast("int"))

    def best_window(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words)), stride)
        return F.array_max(F.transform(starts, lambda k: shared(F.slice(words, k, 2 * F.col("length")))))

    lower = lower_ascii(whole(F.col("text")))
    best_line = F.array_max(F.transform(F.split(lower, "\n"), lambda line: shared(plain_words(line))))
    best = F.greatest(best_line, bind(plain_words(lower), best_window))
    scored = passed.select("doc_id", text_key(F.col("text")).alias("_key"), "label", "needed", F.size("words").alias("size"), best.alias("best"))
    return (
        scored.groupBy("doc_id", "_key", "label")
        .agg(F.max(F.when(F.col("best") >= F.col("needed"), F.col("best") / F.col("size"))).alias("score"))
        .where("score is not null")
    )


def license_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is an empty one: no words, no labels, score 0. ``score`` is the largest share
    of a template that a block holds, if it matches, else 0. Rows that share an id are told
    apart by their texts.
    """
    found = notice_matches(docs).groupBy("doc_id", "_key").agg(
        F.collect_set("label").alias("_labels"), F.max("score").alias("_score")
    )
    found = cut(found, "license-matches").withColumnsRenamed({"doc_id": "_id", "_key": "_text_key"})
    base = docs.select(
        "doc_id",
        text_key(F.col("text")).alias("_key"),
        F.size(plain_words(F.col("text"))).cast("long").alias("n_words"),
        phrase_hits(F.col("text")).alias("_hits"),
    )
    rows = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text_key")), "left")
    own = F.transform("_hits", lambda h: h["label"])
    both = F.array_union(own, F.coalesce("_labels", F.array().cast("array<string>")))
    places = F.transform("_hits", lambda h: h["at"].cast("long"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("_hits").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(own)), ",").alias("base_labels"),
        F.array_join(F.sort_array(both), ",").alias("labels"),
        F.coalesce("_score", F.lit(0.0)).alias("score"),
    )
