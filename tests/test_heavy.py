import random
from collections import Counter

import pyarrow as pa
import pytest

from triagelake.operators import classifier, heavy


@pytest.fixture(scope="module")
def texts():
    """A few frequent terms, many rare ones, empty texts, ties."""
    rng = random.Random(4)
    out = []
    for i in range(300):
        words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(rng.randrange(0, 60))]
        out.append((i, words + ["all"] + [f"rare{i}.{k}" for k in range(8)]))
    return [*out, (300, []), (301, None)]


def plain(texts, wanted, least, share):
    total, df = Counter(), Counter()
    for _, terms in texts:
        total.update(terms or [])
        df.update(set(terms or []))
    good = [(t, df[t], total[t]) for t in total if least <= df[t] <= share * len(texts)]
    return sorted(good, key=lambda r: (-r[2], r[0]))[:wanted]


@pytest.mark.parametrize("kept", [20, 60, 1 << 18])
@pytest.mark.parametrize("wanted,share", [(3, 1.0), (6, 0.95), (25, 0.95)])
def test_frequent_terms_are_the_exact_ones_or_none(spark, texts, kept, wanted, share):
    terms = spark.createDataFrame(texts, "id long, terms array<string>").repartition(5)
    found = heavy.frequent_terms(terms, len(texts), wanted, 2, share, kept)
    assert found is None or found == plain(texts, wanted, 2, share)
    assert found is not None or wanted == 25 or kept < 1 << 18


def test_small_summaries_are_enlarged_until_the_choice_is_proven(spark, texts):
    terms = spark.createDataFrame(texts, "id long, terms array<string>").repartition(5)
    assert heavy.frequent_terms(terms, len(texts), 4, 2, 0.95, 30) == plain(texts, 4, 2, 0.95)
    few = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a"])], "id long, terms array<string>")
    assert heavy.frequent_terms(few, 2, 10, 1, 1.0) == [("a", 2, 3), ("b", 1, 1)]
    assert heavy.frequent_terms(few.limit(0), 0, 10, 1, 1.0) == []


def test_what_a_summary_lacks_is_bounded():
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(1.0))}" for _ in range(5000)]
    exact, held, taken = Counter(words), None, 0
    for at in range(0, 5000, 250):
        counts = Counter(words[at : at + 250])
        part = pa.table({"term": list(counts), "n": pa.array(counts.values(), pa.int64())})
        held, less = heavy.shortened([*([held] if held else []), part], 30)
        taken += less
    got = dict(zip(held["term"].to_pylist(), held["n"].to_pylist(), strict=True))
    assert len(got) <= 30 and taken > 0
    assert all(exact[t] - taken <= got.get(t, 0) <= exact[t] for t in exact)


def test_tables_agree_with_the_full_count(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(2, 5) for _ in range(30))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    quick = sorted(map(tuple, classifier.tfidf_table(df, max_features=20).collect()))
    monkeypatch.setattr(classifier, "frequent_terms", lambda *a: None)
    full = sorted(map(tuple, classifier.tfidf_table(df, max_features=20).collect()))
    assert [r[:3] for r in quick] == [r[:3] for r in full]
    assert all(a[3:] == pytest.approx(b[3:]) for a, b in zip(quick, full, strict=True))


class Batches:
    """Stands in for a table: runs what a task would run, here."""

    def __init__(self, batches):
        self.batches = batches

    def select(self, *columns):
        return self

    def mapInArrow(self, fn, schema):  # noqa: N802
        return list(fn(iter(self.batches)))


def test_a_task_counts_a_large_batch_in_pieces(texts, monkeypatch):
    monkeypatch.setattr(heavy, "PIECE_TERMS", 100, raising=False)
    met, shorten = [], heavy.shortened
    monkeypatch.setattr(heavy, "shortened", lambda parts, kept: met.append(sum(map(len, parts))) or shorten(parts, kept))
    rows = [pa.record_batch([pa.array([t for _, t in texts[:150]], pa.list_(pa.string()))], ["terms"]), pa.record_batch([pa.array([t for _, t in texts[150:]], pa.list_(pa.string()))], ["terms"])]
    told = [r for b in heavy.summaries(Batches(rows), 50) for r in b.to_pylist()]
    assert max(met) <= heavy.SLACK * 50 + 50 + 100
    lacking = sum(r["n"] for r in told if r["term"] is None)
    total = Counter(t for _, terms in texts for t in terms or [])
    held = {r["term"]: r["n"] for r in told if r["term"] is not None}
    assert all(held.get(t, 0) <= n <= held.get(t, 0) + lacking for t, n in total.items())


def test_exact_counts_do_not_depend_on_pieces(spark, texts, monkeypatch):
    terms = spark.createDataFrame(texts, "id long, terms array<string>").coalesce(1)
    whole = heavy.counted_exactly(terms, ["all", "w1", "w2", "rare4.3", "none"])
    monkeypatch.setattr(heavy, "PIECE_TEXTS", 7, raising=False)
    batch = pa.record_batch([pa.array([t for _, t in texts], pa.list_(pa.string()))], ["terms"])
    names = ["all", "w1", "w2", "rare4.3", "none"]
    total, df = Counter(), Counter()
    for _, held in texts:
        total.update(held or [])
        df.update(set(held or []))

    class Summed(Batches):
        def mapInArrow(self, fn, schema):  # noqa: N802
            made = [r for b in fn(iter(self.batches)) for r in b.to_pylist()]
            return spark.createDataFrame(made, schema)

    found = heavy.counted_exactly(Summed([batch]), names)
    assert sorted(found) == sorted(whole) == sorted((t, df[t], total[t]) for t in names if total[t])
