"""Words of a text as columns, shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
# What stands between words of letters and digits, for text in any case.
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def apart(docs: DataFrame, needed: Sequence[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all but the needed columns packed into one, and a function that unpacks them.

    So a column of the caller cannot clash with one that an operator adds on its way.
    """
    others = [c for c in docs.columns if c not in needed]
    packed = docs.select(
        *[c for c in docs.columns if c in needed],
        *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("_rest")] if others else []),
    )

    def back(out: DataFrame, *more: str) -> DataFrame:
        own = [F.col(c) if c in needed else F.col("_rest").getField(c).alias(c) for c in docs.columns]
        return out.select(*own, *[c for c in more if c not in docs.columns])

    return packed, back


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def spaced_words(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed, return."""
    return F.array_remove(F.split(whole(text), SPACE), "")


def plain_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and all characters beyond ASCII, in the case of the text."""
    return F.array_remove(F.split(whole(text), PUNCTUATION), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def windows(words: Column, size: int, value) -> Column:
    """``value`` of every run of ``size`` consecutive words; empty where there are fewer words."""
    last = F.size(words) - (size - 1)
    return F.when(last < 1, F.expr("array()").cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), last), lambda i: value(F.slice(words, i, F.lit(size))))
    )


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id but not a text."""
    return F.xxhash64(whole(text))


def sql_words(text: str, pattern: str = r"[^\x20\x09-\x0D]+") -> str:
    """The words of ``text`` in the dialect of the SQL counterparts."""
    return f"regexp_extract_all(coalesce({text}, ''), '{pattern}')"


def sql_lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"
