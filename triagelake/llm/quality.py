"""Quality rules as a short-circuit cascade.

Every rule says from the text alone whether it rejects a document. On a bounded
sample the cascade measures what each rule costs and how much it rejects, then asks
the rules in the order of rejection per cost; a document that one rule rejects is not
shown to the rules after it. The order changes the work, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.binding import bind
from triagelake.llm.words import SPACE, spaced_words, whole, windows

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
# Whole rows looked at to order the rules. Nothing but the order depends on them.
SAMPLE_ROWS = 400


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Column], Column]


def n_words(text: Column) -> Column:
    return F.size(spaced_words(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points that belong to words."""
    return F.length(F.regexp_replace(whole(text), SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    t = whole(text)
    return (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(whole(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return bind(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words that stand in some run of ``size`` words found at least twice.

    Runs are first compared by a 64-bit hash: without two equal hashes nothing
    repeats. Only then are the runs themselves sorted, so the count is exact.
    """

    def exact(w: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(w) - size),
            lambda i: F.struct(F.array_join(F.slice(w, i + 1, F.lit(size)), " ").alias("run"), i.alias("at")),
        )

        def starts(s: Column) -> Column:
            def twice(j: Column) -> Column:
                here = F.get(s, j)["run"]
                before = F.when(j > 0, F.get(s, j - 1)["run"] == here)
                return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(s, j + 1)["run"] == here, F.lit(False))

            found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), twice)
            return F.sort_array(F.transform(found, lambda j: F.get(s, j)["at"]))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size))))
            return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

        return bind(bind(F.sort_array(runs), starts), covered)

    def maybe(w: Column) -> Column:
        distinct = bind(windows(w, size, F.xxhash64), lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(F.size(w) <= size, 0).when(distinct, 0).otherwise(exact(w))

    return bind(words, maybe).cast("long")


def too_repetitive(words: Column, count: Column) -> Column:
    return 100 * count > MAX_REPEAT_PERCENT * words


BASE_RULES = (
    Rule("few_words", lambda t: n_words(t) < MIN_WORDS),
    Rule("repeated_runs", lambda t: bind(spaced_words(t), lambda w: too_repetitive(F.size(w), repeated_words(w)))),
)

OWN_RULES = (
    # More than one symbol for five words.
    Rule("symbols", lambda t: 5 * n_symbols(t) > n_words(t)),
    # More than two fifths of the lines are repeats.
    Rule(
        "repeated_lines",
        lambda t: bind(lines_with_words(t), lambda x: 5 * (F.size(x) - F.size(F.array_distinct(x))) > 2 * F.size(x)),
    ),
    # Mostly capitals: more ASCII capitals than half of all characters of words.
    Rule(
        "capitals",
        lambda t: 2 * (F.length(whole(t)) - F.length(F.regexp_replace(whole(t), "[A-Z]+", ""))) > word_chars(t),
    ),
    # Words far longer than those of any language written with spaces.
    Rule("long_words", lambda t: word_chars(t) > 20 * n_words(t)),
)


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample of at most ``sample_rows`` whole rows.

    An empty table keeps the given order.
    """
    spark = docs.sparkSession
    rows = docs.select("text").take(sample_rows)
    if not rows:
        return list(rules)
    sample = spark.createDataFrame(rows, "text string")

    def seconds(rejects: Column) -> tuple[float, int]:
        best, n = float("inf"), 0
        for _ in range(2):
            began = time.perf_counter()
            n = sample.agg(F.sum(rejects.cast("int")).alias("n")).first()["n"] or 0
            best = min(best, time.perf_counter() - began)
        return best, n

    floor, _ = seconds(F.col("text").isNull())
    gain = {}
    for rule in rules:
        took, rejected = seconds(rule.rejects(F.col("text")))
        # At least one row in the sample counts as rejected, so a rule that the
        # sample never meets is still placed by its cost.
        gain[rule.name] = max(rejected, 0.5) / max(took - floor, 1e-3)
    return sorted(rules, key=lambda r: (-gain[r.name], r.name))


def rejected_by(text: Column, rules: Sequence[Rule]) -> Column:
    """The first rule, in the given order, that rejects the text; null if none does."""
    chain = None
    for rule in rules:
        chain = (F if chain is None else chain).when(rule.rejects(text), F.lit(rule.name))
    return F.lit(None).cast("string") if chain is None else chain


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + OWN_RULES) -> DataFrame:
    """``docs`` with ``rejected_by``: a rule that rejects the row, null for rows to keep.

    A null text is an empty one. Rows are judged one by one, so repeated rows, null ids
    and extra columns change nothing. A column named ``rejected_by`` is replaced. Which
    rule is named where several reject depends on the measured order.
    """
    return docs.withColumn("rejected_by", rejected_by(F.col("text"), order_rules(docs, rules)))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + OWN_RULES) -> DataFrame:
    """``docs`` without the rows that a rule rejects; all columns stay."""
    return docs.where(rejected_by(F.col("text"), order_rules(docs, rules)).isNull())


def quality_report(docs: DataFrame) -> DataFrame:
    """The base counts of every document and the verdict of all rules."""
    ordered = order_rules(docs, OWN_RULES)
    words = docs.select("doc_id", "text", spaced_words(F.col("text")).alias("_words"))
    counts = words.select(
        "doc_id",
        "text",
        F.size("_words").cast("long").alias("n_words"),
        word_chars(F.col("text")).alias("word_chars"),
        n_symbols(F.col("text")).alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )
    base = (F.col("n_words") < MIN_WORDS) | too_repetitive(F.col("n_words"), F.col("n_repeat_words"))
    return counts.withColumn("base_failed", base).select(
        *[c for c in counts.columns if c != "text"],
        "base_failed",
        F.when(F.col("base_failed"), False).otherwise(rejected_by(F.col("text"), ordered).isNull()).alias("kept"),
    )
