"""Keyword and label rules as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from importlib.util import find_spec

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from triagelake.functions.binding import bind
from triagelake.functions.text import _col, query_text
from triagelake.functions.vocabulary import (
    CATEGORY_KEYWORDS,
    FULL_CONFIDENCE_HITS,
    ISSUE_SEVERITY_LABELS,
    ISSUE_SEVERITY_PHRASES,
    LABEL_CATEGORIES,
    SEVERITY_DEFAULT,
    SEVERITY_PHRASES,
)
from triagelake.schema import KNOWN_CATEGORIES, UNKNOWN


def _contains_any(text: Column, phrases: list[str]) -> Column:
    hit = F.contains(text, F.lit(phrases[0]))
    for phrase in phrases[1:]:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit


def _first_match(tests: list[tuple[str, Column]], default: Column) -> Column:
    (value, test), rest = tests[0], tests[1:]
    chain = F.when(test, F.lit(value))
    for value, test in rest:
        chain = chain.when(test, F.lit(value))
    return chain.otherwise(default)


def category_from_labels(labels: str | Column) -> Column:
    """Category of the first label that is a known one; failing that, of the
    first (label, known label) pair where one is part of the other."""
    lowered = F.transform(F.array_compact(F.coalesce(_col(labels), F.array().cast("array<string>"))), F.lower)
    known = F.create_map(*[F.lit(x) for pair in LABEL_CATEGORIES.items() for x in pair])
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), F.lit(v).alias("category")) for k, v in LABEL_CATEGORIES.items()]
    )
    exact = F.filter(F.transform(lowered, lambda label: F.element_at(known, label)), lambda c: c.isNotNull())
    partial = F.flatten(
        F.transform(
            lowered,
            lambda label: F.filter(
                entries, lambda e: F.contains(label, e["key"]) | F.contains(e["key"], label)
            ),
        )
    )
    return F.coalesce(F.get(exact, 0), F.get(partial, 0)["category"], F.lit(UNKNOWN))


def category_from_text(text: str | Column, engine: str = "scan") -> Column:
    """``struct<category, confidence>`` from the number of distinct keywords of
    each category that occur in the text as substrings.

    engine="scan" finds all keywords in one pass per text, on Arrow batches; it needs
    pyahocorasick on driver and executors, and where the driver lacks it "expr" stands in.
    engine="expr" is the same rule in built-in expressions only: one substring
    search per keyword, which costs several times more on long texts.
    """
    return category_of(F.lower(_col(text)), engine)


def category_of(lowered: Column, engine: str = "scan") -> Column:
    """`category_from_text` for a text that is in lower case already."""
    if engine == "scan" and find_spec("ahocorasick") is None:
        engine = "expr"  # decided here, for all executors alike
    if engine == "scan":
        best = _scan_keywords(lowered)
    elif engine == "expr":
        best = _score_by_expressions(lowered)
    else:
        raise ValueError(f"unknown engine: {engine}")
    return F.struct(
        best["category"].alias("category"),
        F.least(best["score"] / F.lit(float(FULL_CONFIDENCE_HITS)), F.lit(1.0)).alias("confidence"),
    )


def _score_by_expressions(lowered: Column) -> Column:
    def best(text: Column) -> Column:
        # Words sit in array literals: 138 separate conditions would outgrow the
        # size of method the JVM is willing to compile.
        scored = [
            F.struct(
                F.size(
                    F.filter(F.array(*[F.lit(w) for w in CATEGORY_KEYWORDS[c]]), lambda w: F.contains(text, w))
                ).alias("score"),
                F.lit(-i).alias("order"),
                F.lit(c).alias("category"),
            )
            for i, c in enumerate(KNOWN_CATEGORIES)
        ]
        nothing = F.struct(
            F.lit(0).alias("score"), F.lit(1).alias("order"), F.lit(UNKNOWN).alias("category")
        )
        return F.array_max(F.array(nothing, *scored))

    return bind(lowered, best)


_BEST = T.StructType(
    [T.StructField("category", T.StringType()), T.StructField("score", T.IntegerType())]
)


@arrow_udf(_BEST)
def _scan_keywords(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    find = _keyword_finder()
    owners: dict[str, list[int]] = {}
    for i, category in enumerate(KNOWN_CATEGORIES):
        for word in CATEGORY_KEYWORDS[category]:
            owners.setdefault(word, []).append(i)
    for texts in batches:
        categories, scores = [], []
        for text in texts.to_pylist():
            counts = [0] * len(KNOWN_CATEGORIES)
            for word in find(text or ""):
                for i in owners[word]:
                    counts[i] += 1
            top = max(counts)
            categories.append(KNOWN_CATEGORIES[counts.index(top)] if top else UNKNOWN)
            scores.append(top)
        yield pa.StructArray.from_arrays(
            [pa.array(categories, pa.string()), pa.array(scores, pa.int32())], ["category", "score"]
        )


def _keyword_finder():
    import ahocorasick

    words = sorted({w for group in CATEGORY_KEYWORDS.values() for w in group})
    automaton = ahocorasick.Automaton()
    for word in words:
        automaton.add_word(word, word)
    automaton.make_automaton()
    return lambda text: {word for _, word in automaton.iter(text)}


def estimate_severity(title: str | Column = "title", description: str | Column = "description") -> Column:
    return severity_of(F.lower(query_text(title, description)))


def severity_of(lowered: Column) -> Column:
    """Severity of a text in lower case."""
    tests = [(severity, _contains_any(lowered, phrases)) for severity, phrases in SEVERITY_PHRASES]
    return _first_match(tests, F.lit(SEVERITY_DEFAULT))


def infer_issue_severity(
    title: str | Column = "title", body: str | Column = "body", labels: str | Column = "labels"
) -> Column:
    """Severity labels win over words in the text; a text never makes an issue critical."""
    return issue_severity_of(F.lower(query_text(title, F.coalesce(_col(body), F.lit("")))), _col(labels))


def issue_severity_of(lowered: Column, labels: Column) -> Column:
    """`infer_issue_severity` for a text in lower case."""
    names = F.transform(F.coalesce(labels, F.array().cast("array<string>")), F.lower)
    tests = [
        (severity, F.coalesce(F.arrays_overlap(names, F.array(*[F.lit(x) for x in wanted])), F.lit(False)))
        for severity, wanted in ISSUE_SEVERITY_LABELS
    ] + [(severity, _contains_any(lowered, phrases)) for severity, phrases in ISSUE_SEVERITY_PHRASES]
    return _first_match(tests, F.lit(UNKNOWN))
