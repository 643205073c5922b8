"""The most frequent terms of a corpus in two passes, without a shuffle of its rare ones.

First every task counts terms in a summary of bounded size: when it grows too large, the
count of the first one that has no place is taken from all (Misra and Gries). Summaries add up, and so
do the amounts taken, which bound what any count lacks. Then the terms with the highest counts are
counted exactly, and only they. If the last term that is chosen occurs more often than any
term outside can, the choice is proven; if not, the summaries are made larger.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.session import cut

# Terms that a task's summary keeps, how much larger it may grow meanwhile, and how often it is enlarged.
KEPT_TERMS = 1 << 18
SLACK = 2
LARGER, TRIES = 4, 3
# Terms and texts of a batch that a task counts at a time.
PIECE_TERMS, PIECE_TEXTS = 1 << 18, 512
# Candidates for each term that is wanted.
CANDIDATES = 4


def frequent_terms(
    terms: DataFrame, documents: int, wanted: int, min_documents: int, max_share: float, kept: int = KEPT_TERMS
) -> list[tuple[str, int, int]] | None:
    """``(term, documents, total)`` of the ``wanted`` most frequent terms of ``(id, terms)``, most frequent first.

    Terms in fewer than ``min_documents`` texts or in more than ``max_share`` of them do not
    count; equal totals are ordered by term. None if that cannot be proven: then there are too few
    eligible terms, or too many of about the same frequency.
    """
    for _ in range(TRIES):
        counted = cut(summaries(terms, kept), "summaries")
        lacking = counted.where("term is null").agg(F.sum("n")).first()[0] or 0
        totals = counted.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
        top = totals.orderBy(F.desc("n"), "term").limit(CANDIDATES * wanted + 1).collect()  # bounded by what is wanted
        outside = lacking + (top.pop()["n"] if len(top) > CANDIDATES * wanted else 0)
        exact = counted_exactly(terms, [r["term"] for r in top])
        eligible = [r for r in exact if min_documents <= r[1] <= max_share * documents]
        eligible.sort(key=lambda r: (-r[2], r[0]))
        chosen = eligible[:wanted]
        if outside < min_documents or len(chosen) == wanted and chosen[-1][2] > outside:
            return chosen
        if not lacking:
            return None
        kept *= LARGER
    return None


def summaries(terms: DataFrame, kept: int) -> DataFrame:
    """``(term, n)`` of each task: counts that lack at most the ``n`` of its row without a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, rows, taken = None, [], 0, 0
        for piece in flat_pieces(batches):
            counts = piece.value_counts()
            waiting.append(pa.table({"term": counts.field("values"), "n": counts.field("counts")}))
            rows += len(counts)
            if rows > SLACK * kept:
                held, less = shortened([*([held] if held else []), *waiting], kept)
                waiting, rows, taken = [], 0, taken + less
        if waiting or held:
            held, less = shortened([*([held] if held else []), *waiting], kept)
            taken += less
            own = pa.table({"term": pa.array([None], pa.string()), "n": pa.array([taken], pa.int64())})
            yield from pa.concat_tables([held, own]).to_batches()

    return terms.select("terms").mapInArrow(run, "term string, n long")


def flat_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """All terms, at most ``PIECE_TERMS`` at a time: what a task counts does not grow with its batches."""
    for batch in batches:
        flat = batch.column("terms").flatten()
        for start in range(0, len(flat), PIECE_TERMS):
            yield flat.slice(start, PIECE_TERMS)


def shortened(parts: list[pa.Table], kept: int) -> tuple[pa.Table, int]:
    """The summed counts, at most ``kept`` of them, and what was taken from each."""
    table = pa.concat_tables(parts).group_by("term").aggregate([("n", "sum")])
    table = table.select(["term", "n_sum"]).rename_columns(["term", "n"])
    if len(table) <= kept:
        return table, 0
    n = table["n"].to_numpy()
    less = int(np.partition(n, len(n) - kept - 1)[len(n) - kept - 1])
    left = table.set_column(1, "n", pc.subtract(table["n"], less))
    return left.filter(pc.greater(left["n"], 0)), less


def counted_exactly(terms: DataFrame, candidates: Sequence[str]) -> list[tuple[str, int, int]]:
    """(term, texts that hold it, times it occurs) of the candidates, a bounded number of terms."""
    names = list(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        texts, totals = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for lists in (b.column("terms").slice(i, PIECE_TEXTS) for b in batches for i in range(0, b.num_rows, PIECE_TEXTS)):
            place = pc.index_in(lists.flatten(), value_set=known)
            found = np.nonzero(~np.asarray(place.is_null()))[0]
            at = pc.fill_null(place, 0).to_numpy()[found].astype(np.int64)
            text = lists.value_parent_indices().to_numpy()[found].astype(np.int64)
            totals += np.bincount(at, minlength=len(names))
            texts += np.bincount(np.unique(text * len(names) + at) % max(len(names), 1), minlength=len(names))
        held = np.nonzero(totals)[0]
        yield pa.RecordBatch.from_pydict({"place": pa.array(held), "texts": pa.array(texts[held]), "total": pa.array(totals[held])})

    if not names:
        return []
    sums = terms.select("terms").mapInArrow(run, "place long, texts long, total long")
    found = sums.groupBy("place").agg(F.sum("texts").alias("texts"), F.sum("total").alias("total")).collect()  # a row per candidate
    return [(names[r["place"]], r["texts"], r["total"]) for r in found]
