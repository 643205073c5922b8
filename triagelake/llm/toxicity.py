"""Toxicity by a classifier chain.

Categories are predicted one after the other. The model of a category is linear in the
words of a text, their beginnings, and the log-odds that the earlier models of the chain
give. So that a later model learns from what earlier ones really predict, it is trained on
out-of-fold predictions: each labelled row is scored by a model that has not seen it.

The chain is fitted on a bounded sample of labelled rows, in one task whose input that
bound limits. Scoring runs over all texts where they lie.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.session import cut

CHAIN = ("low_quality", "toxic")
# Toxic texts are to be caught; clean ones lie far below this on rows not learned from.
LIMIT = 0.25
# Labelled rows a chain is fitted on, drawn by a hash of their id.
MAX_LABELLED = 20_000
FOLDS = 3
FEATURES = 2**20
# Beginnings of words that are features beside the whole word.
STEMS = (4, 6, 8)
# Words that are scored together.
BLOCK = 300
# Features must stand in so many labelled rows.
LEAST_ROWS = 3
ITERATIONS = 40
PENALTY = 3e-4
# Scores of words each scoring task remembers before it starts anew.
REMEMBERED = 500_000


def distinct_words(words: list[bytes]) -> set[bytes]:
    """Words without punctuation at their ends."""
    found = {w.strip(b".,;:!?\"'()[]{}#*$%&|<>-") for w in words}
    found.discard(b"")
    return found


def split_words(text: str | None) -> list[bytes]:
    """Runs between white space, ASCII in lower case."""
    return (text or "").encode().lower().split()


def blocks(words: list[bytes]) -> list[list[bytes]]:
    """Consecutive words in blocks of ``BLOCK``; a rest under half a block joins the last one."""
    cuts = list(range(0, max(1, len(words) - BLOCK // 2), BLOCK))
    return [words[a:b] for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True)]


def word_features(word: bytes) -> list[int]:
    """Numbers of the word and of its beginnings; bytes, so any alphabet will do."""
    import xxhash

    found = [xxhash.xxh64_intdigest(word, 1) % FEATURES]
    found += [xxhash.xxh64_intdigest(word[:n], 2) % FEATURES for n in STEMS if len(word) >= n]
    return found


def minimised(loss, start: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking; ``loss`` gives value and gradient."""
    x, (value, slope) = start, loss(start)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        direction, kept = slope.copy(), []
        for s, y, r in reversed(steps):
            a = r * s.dot(direction)
            direction -= a * y
            kept.append(a)
        if steps:
            s, y, _ = steps[-1]
            direction *= s.dot(y) / y.dot(y)
        for (s, y, r), a in zip(steps, reversed(kept), strict=True):
            direction += s * (a - r * y.dot(direction))
        fall = slope.dot(direction)
        if fall <= 1e-12:
            break
        size = 1.0 if steps else min(1.0, 1.0 / np.sqrt(fall))
        for _ in range(20):
            new = x - size * direction
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, y = new - x, new_slope - slope
        if s.dot(y) > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / s.dot(y))]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        x, value, slope = new, new_value, new_slope
        if done:
            break
    return x


class Sums:
    """Sums of values over runs of a given length each."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.n = len(lengths)
        self.some = np.flatnonzero(lengths)
        self.starts = (np.cumsum(lengths) - lengths)[self.some]

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self.some):
            out[self.some] = np.add.reduceat(values, self.starts)
        return out


class Rows:
    """Sparse rows of ones, kept by row and by column, plus a few dense columns."""

    def __init__(self, rows: list[np.ndarray], size: int, dense: np.ndarray) -> None:
        lengths = np.array([len(r) for r in rows], np.int64)
        self.columns = np.concatenate(rows) if rows else np.empty(0, np.int32)
        self.by_row = Sums(lengths)
        row_of = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
        self.rows = row_of[np.argsort(self.columns, kind="stable")]
        self.by_column = Sums(np.bincount(self.columns, minlength=size))
        self.size, self.dense = size, dense

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return self.by_row.of(weights[self.columns]) + self.dense @ weights[self.size :]

    def gradient(self, errors: np.ndarray) -> np.ndarray:
        return np.concatenate([self.by_column.of(errors[self.rows]), self.dense.T @ errors])


def fitted(rows: Rows, target: np.ndarray) -> np.ndarray:
    """Weights of a logistic model with a squared penalty on all but the constant, the last of them."""
    free = np.ones(rows.size + rows.dense.shape[1])
    free[-1] = 1e-6

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows.scores(w)
        value = np.logaddexp(0, z).mean() - (target * z).mean() + PENALTY / 2 * (free * w * w).sum()
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(target)
        return value, rows.gradient(error) + PENALTY * free * w

    return minimised(loss, np.zeros(rows.size + rows.dense.shape[1]), ITERATIONS)


def squashed(z: np.ndarray) -> np.ndarray:
    """Log-odds as a later model sees them."""
    return np.clip(z, -10, 10)


def text_features(text: str | None) -> np.ndarray:
    return np.array(sorted(f for w in distinct_words(split_words(text)) for f in word_features(w)), np.int32)


def fit_rows(raw: list[np.ndarray], targets: np.ndarray, folds: np.ndarray) -> dict:
    """The chain for targets in columns: active features, and weights per category.

    ``raw`` has the features of each row; it is emptied on the way, as it is the bulk of the memory.
    """
    in_rows = np.zeros(FEATURES, np.int32)
    for row in raw:
        in_rows[np.unique(row)] += 1
    active = np.flatnonzero(in_rows >= LEAST_ROWS)
    place = np.full(FEATURES, -1, np.int32)
    place[active] = np.arange(len(active), dtype=np.int32)
    rows = []
    for i, row in enumerate(raw):
        there = place[row]
        rows.append(there[there >= 0])
        raw[i] = there[:0]

    n, categories = targets.shape
    odds = np.zeros((n, 0))
    weights = []
    for c in range(categories):
        dense = np.hstack([odds, np.ones((n, 1))])
        everything = Rows(rows, len(active), dense)
        weights.append(fitted(everything, targets[:, c]))
        out = np.zeros(n)
        for fold in range(FOLDS) if c + 1 < categories else ():
            own, others = np.flatnonzero(folds == fold), np.flatnonzero(folds != fold)
            model = weights[-1]
            if len(others):
                model = fitted(Rows([rows[i] for i in others], len(active), dense[others]), targets[others, c])
            out[own] = Rows([rows[i] for i in own], len(active), dense[own]).scores(model)
        odds = np.hstack([odds, squashed(out)[:, None]])
    return {"active": active, "weights": weights}


def labels_sample(labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """About ``bound`` labels at most, the same ones whenever it is asked."""
    n = labels.count()
    if n <= bound:
        return labels
    return labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) < int(2**32 * bound / n))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CHAIN, bound: int = MAX_LABELLED) -> dict:
    """The chain of ``categories``, in order, from the texts of ``docs`` and ``labels``.

    ``labels`` has doc_id and a 0/1 column per category. Rows with a null in any of them are
    left out, labels of unknown ids not used; repeated rows count as often as they stand. A
    category with one value gets a model that leans to it. Without labelled rows there is
    nothing to learn and an error says so.
    """
    names = list(categories)
    complete = labels.dropna(subset=["doc_id", *names]).select(
        F.col("doc_id").alias("_id"), *[F.col(c).cast("double").alias(f"_mark_{c}") for c in names]
    )
    sample = cut(labels_sample(complete.withColumnRenamed("_id", "doc_id"), bound), "labels")
    # The sample is bounded, so the texts stay where they are.
    sample = docs.select(F.col("doc_id").alias("_of"), "text").join(F.broadcast(sample), F.col("_of") == F.col("doc_id")).drop("_of")
    sample = sample.withColumnsRenamed({f"_mark_{c}": c for c in names})
    sample = sample.withColumn("_fold", F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(FOLDS)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts become features as they come; only those are held.
        found = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("text", "doc_id", "_fold", *names)]
            for text, doc_id, fold, *marks in zip(*columns, strict=True):
                found.append((doc_id, fold, marks, text_features(text)))
        if not found:
            return
        # One order of the rows, whatever order they came in, gives one model.
        found.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3].tobytes(), r[2]))
        targets = np.array([r[2] for r in found], np.float64)
        folds = np.array([r[1] or 0 for r in found])
        raw = [r[3] for r in found]
        found.clear()
        model = fit_rows(raw, targets, folds)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()  # one row; features bound its size
    if not found:
        raise ValueError("no labelled rows")
    return {"categories": names, **pickle.loads(bytes(found[0]["model"]))}


def chain_probabilities(docs: DataFrame, chain: dict) -> DataFrame:
    """doc_id and ``p_<category>`` of every row; a null text is an empty one.

    A text is scored block by block and has the highest probability of its blocks, so a
    passage counts the same in a long text as in a short one.
    """
    names = [f"p_{c}" for c in chain["categories"]]
    known = len(chain["active"])
    # Only weights that count travel; words' scores per category are sums of them.
    model = {
        "active": chain["active"],
        "words": np.column_stack([w[:known] for w in chain["weights"]]).astype(np.float64),
        "dense": [w[known:].tolist() for w in chain["weights"]],
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {int(f): i for i, f in enumerate(model["active"])}
        table, none = model["words"], np.zeros(len(names))
        remembered: dict[bytes, np.ndarray] = {}

        def word_score(word: bytes) -> np.ndarray:
            score = remembered.get(word)
            if score is None:
                if len(remembered) >= REMEMBERED:
                    remembered.clear()
                at = [places[f] for f in word_features(word) if f in places]
                score = remembered[word] = table[at].sum(axis=0) if at else none
            return score

        for batch in batches:
            out = np.zeros((batch.num_rows, len(names)))
            for i, text in enumerate(batch.column("text").to_pylist()):
                for block in blocks(split_words(text)):
                    scores = [s for w in sorted(distinct_words(block)) if (s := word_score(w)) is not none]
                    total = np.sum(scores, axis=0) if scores else none
                    odds: list[float] = []
                    for c, dense in enumerate(model["dense"]):
                        z = total[c] + sum(w * x for w, x in zip(dense, [*odds, 1.0], strict=True))
                        odds.append(min(10.0, max(-10.0, z)))
                        out[i, c] = max(out[i, c], 1 / (1 + math.exp(-min(50.0, max(-50.0, z)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *[pa.array(out[:, c]) for c in range(len(names))]],
                names=["doc_id", *names],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, p_low_quality, p_toxic, toxic.

    ``labels`` (doc_id, quality, toxic) covers some of the documents. Repeated rows, null ids
    and extra columns of ``docs`` do not matter; labels of unknown ids are not used. No
    documents give no rows; documents without any label are an error, as there is nothing to learn from.
    """
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, p_low_quality double, p_toxic double, toxic boolean")
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = fit_chain(docs, marks)
    return chain_probabilities(docs, chain).withColumn("toxic", F.col("p_toxic") >= LIMIT)


def keep_clean(docs: DataFrame, chain: dict, category: str = "toxic", limit: float = LIMIT) -> DataFrame:
    """``docs`` without rows of the category; all columns stay."""
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    scored = chain_probabilities(docs.select(key.alias("doc_id"), "text"), chain).where(F.col(f"p_{category}") >= limit)
    gone = cut(scored.select(F.col("doc_id").alias("_gone")).distinct(), "toxic-texts")
    return docs.join(gone, key == gone["_gone"], "left_anti")
