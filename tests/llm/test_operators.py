"""The operators against plain versions, and on awkward tables."""

import contextlib
import io
import os
import random

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from plain import PLAIN, WORD
from pyspark.sql import functions as F

import plain
from triagelake.llm import decontam, licenses, lines, mixing, neardup, quality, suffixes, tokens, toxicity, urls
from triagelake.llm.sql import LICENSES
from triagelake.session import SHUFFLE_CLEANUP

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


def frame(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], schema)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    """Null, empty, blank, tiny, very long, equal and nearly equal texts, odd characters."""
    rng = random.Random(5)
    long = sentence(rng, 6000)
    base = [sentence(rng, 120) for _ in range(6)]
    near = [b.replace(b.split()[40], "changed", 1) for b in base]
    passage = sentence(rng, 130)
    inside = [f"{sentence(rng, 30)} {passage} {sentence(rng, 25)}" for _ in range(12)]
    cuts = [f"{sentence(rng, 20)} {passage[i * 7 : i * 7 + 420]} {sentence(rng, 20)}" for i in range(12)]
    odd = ["É" * 30 + " \u00a0x\x0by\x0cz \x1c q", "a\nb\na\n\n \t\nb", "😀 " * 150, "ab" * 700, "x" * 1500, "\x00" * 500]
    return [None, "", " \n\t", "one", "One", "a b c d", long, long + " tail", *base, *base, *near, *inside, *cuts, *odd, *odd]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_quality(spark, awkward):
    found = {r["doc_id"]: r.asDict() for r in quality.quality_report(frame(spark, awkward)).collect()}
    for i, text in enumerate(awkward):
        wanted = plain.quality(text)
        assert {c: found[i][c] for c in wanted} == wanted, text
        assert not (found[i]["base_failed"] and found[i]["kept"])


def test_quality_order_does_not_change_the_verdict(spark, awkward):
    docs = frame(spark, awkward)
    one = docs.select("doc_id", quality.rejected_by(F.col("text"), quality.OWN_RULES).isNull().alias("k"))
    other = docs.select("doc_id", quality.rejected_by(F.col("text"), quality.OWN_RULES[::-1]).isNull().alias("k"))
    assert by_id(one, "k") == by_id(other, "k")
    ordered = quality.order_rules(docs, quality.BASE_RULES + quality.OWN_RULES)
    assert {r.name for r in ordered} == {r.name for r in quality.BASE_RULES + quality.OWN_RULES}
    kept = quality.quality_cascade(docs.withColumn("rejected_by", F.lit(1)))
    assert kept.columns == [*docs.columns, "rejected_by"] and kept.count() == len(awkward)


def test_near_duplicates(spark, awkward):
    found = by_id(neardup.near_duplicates(frame(spark, awkward)), "n_shingles", "component_id", "kept")
    wanted = plain.near_duplicates(list(enumerate(awkward)))
    assert found == {i: (n, c, c == i) for i, (n, c) in wanted.items()}


def test_near_duplicates_in_chains_and_crowds(spark):
    """Links between members of one bucket that its smallest member does not see."""
    rng = random.Random(9)
    words = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for step in range(24):
        # Each text is a little further from the first; neighbours link, ends do not.
        texts.append(" ".join([*(f"n{step}.{j}" for j in range(2)), *words[step * 4 :], *(f"t{k}" for k in range(step * 4))]))
    for _ in range(120):
        some = words[:]
        for _ in range(5):
            some[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(some))
    rng.shuffle(texts)
    found = by_id(neardup.near_duplicates(frame(spark, texts)), "n_shingles", "component_id")
    assert found == plain.near_duplicates(list(enumerate(texts)))


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (None, a), (4, None)], "doc_id long, text string")
    rows = sorted(neardup.near_duplicates(docs).collect(), key=str)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows} == {
        (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (4, 4, True),
    }
    assert len(rows) == 6
    assert sorted(r["doc_id"] or 0 for r in neardup.drop_near_duplicates(docs).collect()) == [0, 1, 1, 4]


def test_estimate_follows_similarity(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(4000)]
    other = words[:]
    for i in range(0, 4000, 40):
        other[i] = f"z{rng.random()}"
    sigs = neardup.signatures(frame(spark, [" ".join(words), " ".join(other)]))
    a, b = (sigs.where(f"doc_id = {i}").select(F.col("sig").alias(f"s{i}")) for i in (0, 1))
    got = a.join(b).select(neardup.estimate(F.col("s0"), F.col("s1")).alias("e")).first()["e"]
    x, y = plain.shingles(" ".join(words)), plain.shingles(" ".join(other))
    assert abs(got - len(x & y) / len(x | y)) < 0.15


@pytest.mark.parametrize("most", [suffixes.MOST_RUNS, 2])
def test_repeated_bytes(spark, awkward, most):
    found = by_id(suffixes.byte_report(frame(spark, awkward), most), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [found[i] for i in range(len(awkward))] == plain.repeated_bytes(awkward)


def test_repeated_bytes_over_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.collect()]
    found = suffixes.byte_report(docs).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == plain.repeated_bytes(texts)


def test_deep_shallow_sort():
    rng = random.Random(4)
    for _ in range(300):
        stem = bytes(rng.choice(b"ab") for _ in range(rng.randrange(90)))
        strings = [stem + bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 30))]
        strings += rng.sample(strings, len(strings) // 2)
        order, prefixes = suffixes.deep_shallow_sort(strings, len(stem) if rng.random() < 0.5 else 0)
        assert sorted(order) == list(range(len(strings)))
        assert [strings[i] for i in order] == sorted(strings)
        for k in range(1, len(order)):
            a, b = strings[order[k - 1]], strings[order[k]]
            assert prefixes[k] == suffixes.common_prefix(a, b)


def test_drop_repeated_bytes_keeps_columns(spark):
    text = "é" * 300
    docs = frame(spark, [text, "short " + text, None]).withColumn("spans", F.lit(1))
    out = suffixes.drop_repeated_bytes(docs)
    assert out.columns == docs.columns
    assert by_id(out, "text") == {0: ("",), 1: ("short ",), 2: (None,)}


def test_contamination(spark, awkward):
    benchmark = [(1, awkward[8]), (2, "one"), (3, ""), (4, None), (5, "W1 w2, w3"), (6, awkward[9] + " " + awkward[8])]
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    found = decontam.contamination_report(frame(spark, awkward), items)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(tuple(r[c] for c in names) for r in found.collect()) == plain.contamination(list(enumerate(awkward)), benchmark)


def test_contamination_by_an_instruction_that_many_items_share(spark, monkeypatch):
    shared = " ".join(f"s{i}" for i in range(12))
    benchmark = [(i, f"{shared} own{i} " + " ".join(f"q{i}x{j}" for j in range(9))) for i in range(300)] + [(None, shared)]
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    texts = [shared, f"{shared} own7 " + " ".join(f"q7x{j}" for j in range(9)), "clean", None, benchmark[4][1] + " " + benchmark[9][1]]
    wanted = plain.contamination(list(enumerate(texts)), [x for x in benchmark if x[0] is not None])
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for limit in (decontam.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
        found = decontam.contamination_report(frame(spark, texts), items)
        assert sorted(tuple(r[c] for c in names) for r in found.collect()) == wanted
    known = decontam.benchmark_windows(decontam.window_items(items))
    assert "array<bigint>" not in dict(known.dtypes).values()
    assert known.select("items_key").distinct().count() == 1 + 300


def test_decontaminate_removes_spans_or_documents(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    items = spark.createDataFrame([(1, passage.upper())], "item_id long, text string")
    docs = frame(spark, [f"¡Before, {passage}! After it.", "clean text", None, passage]).withColumn("hits", F.lit(2))
    kept = decontam.decontaminate(docs, items, "documents")
    assert kept.columns == docs.columns and sorted(by_id(kept, "hits")) == [1, 2]
    spans = by_id(decontam.decontaminate(docs, items), "text")
    assert spans == {0: ("¡Before, After it.",), 1: ("clean text",), 2: (None,), 3: ("",)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, none, "documents").count() == 4
    with pytest.raises(ValueError):
        decontam.decontaminate(docs, items, "lines")


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines(spark, edits):
    rng = random.Random(edits)
    pool = ["".join(rng.choice("abcde é") for _ in range(rng.randrange(30, 46))).strip() for _ in range(25)]

    def changed(line):
        some = list(line)
        for _ in range(rng.randrange(edits + 2)):
            at = rng.randrange(len(some))
            some[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
        return "".join(some)

    texts = ["\n".join([*(changed(rng.choice(pool)) for _ in range(8)), "short", " short\t"]) for _ in range(40)]
    texts += [None, "", texts[0], "\n\n"]
    found = by_id(lines.line_report(frame(spark, texts), edits), "n_lines", "n_repeated", "kept_chars")
    assert found == plain.lines(list(enumerate(texts)), edits, lines.LEAST_LENGTH)


def test_lines_with_edits_that_grow(spark):
    rng = random.Random(21)
    pool = ["".join(rng.choice("abcde é") for _ in range(n)).strip() for n in (18, 21, 24, 30, 39, 41, 59, 61, 79, 85, 120, 178, 190, 260, 420)]

    def changed(line):
        some = list(line)
        for _ in range(rng.randrange(len(line) // 20 + 2)):
            at = rng.randrange(len(some))
            some[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
        return "".join(some).strip() or "x"

    texts = ["\n".join(changed(rng.choice(pool)) for _ in range(6)) for _ in range(60)] + [None, "", "\n\n"]
    places = {}
    for i, text in enumerate(texts):
        for at, line in enumerate(dict.fromkeys(x for x in (text or "").split("\n") if x)):
            places.setdefault(line, []).append((i, at))
    later = {
        max(a, b, key=lambda line: places[line][0])
        for a in places for b in places
        if a < b and abs(len(a) - len(b)) <= 30 and plain.distance(a, b) <= max(len(a), len(b)) // 20
    }
    gone = [0] * len(texts)
    for line, where in places.items():
        for i, _ in where:
            gone[i] += line in later or i != where[0][0]
    found = by_id(lines.line_report(frame(spark, texts)), "n_repeated")
    assert [found[i][0] for i in range(len(texts))] == gone
    assert any(len(line) > 150 for line in later) and any(len(line) < lines.LEAST_LENGTH for line in later)


def test_lines_in_bands_of_lengths(spark, monkeypatch):
    """Similar lines are found within a band of lengths and over its ends, with all shuffles deleted on the way."""
    monkeypatch.setattr(lines, "BANDS", 4)
    monkeypatch.setattr(lines, "BAND_POINTS", 1)
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcde é") for _ in range(n)).strip() for n in (22, 40, 41, 60, 79, 80, 100, 160, 200)]

    def changed(line):
        some = list(line)
        for _ in range(rng.randrange(len(line) // 20 + 2)):
            at = rng.randrange(len(some))
            some[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
        return "".join(some).strip() or "x"

    # Repeats inside a line: a key stands at several places.
    texts = [changed(rng.choice(pool)) for _ in range(70)] + [changed("abcdefghijkl" * 12) for _ in range(6)]
    firsts = spark.createDataFrame([(len(x),) for x in set(texts)], "length int")
    lows = lines.band_lows(firsts)
    assert lows[0] == lines.PER_EDIT and len(lows) == 4 and lows == sorted(set(lows))
    before = spark.conf.get(SHUFFLE_CLEANUP)
    found = by_id(lines.line_report(frame(spark, texts)), "n_repeated")
    assert spark.conf.get(SHUFFLE_CLEANUP) == before
    for i, b in enumerate(texts):
        gone = any(abs(len(a) - len(b)) <= 10 and (a == b or min(len(a), len(b)) and max(len(a), len(b)) >= 20 and min(len(a), len(b)) >= 20
                   and plain.distance(a, b) <= max(len(a), len(b)) // 20) for a in texts[:i])
        assert found[i] == (int(gone),), b
    over = [low for low in lows[1:] if any(len(a) < low <= len(b) and plain.distance(a, b) <= len(b) // 20 for a in texts for b in texts)]
    assert over


def test_near_copies_are_not_all_paired(spark, monkeypatch):
    """Of a large group few pairs are compared in rows; lines that these do not settle are held against all in blocks."""
    monkeypatch.setattr(lines, "BLOCK", 10)
    rng = random.Random(17)
    base = "".join(rng.choice("abcdefgh ij") for _ in range(100)).replace(" ", "k", 1)

    def replaced(edits):
        some = list(base)
        for at in rng.sample(range(len(base)), edits):
            some[at] = rng.choice("xyz")
        return "".join(some)

    # Near copies, copies too far from each other, and lines that only share a passage.
    texts = [replaced(2) for _ in range(45)] + [replaced(8) for _ in range(20)]
    texts += ["".join(rng.choice("lmnop") for _ in range(n)) + base[:50] for n in (45, 46, 48, 50, 50, 52)]
    rng.shuffle(texts)
    seen, similar_pairs = [], lines.similar_pairs

    def counted(pairs, edits):
        seen.append(pairs.count())
        return similar_pairs(pairs, edits)

    monkeypatch.setattr(lines, "similar_pairs", counted)
    found = by_id(lines.line_report(frame(spark, texts)), "n_repeated")
    for i, b in enumerate(texts):
        assert found[i] == (int(any(plain.distance(a, b) <= max(len(a), len(b)) // 20 for a in texts[:i])),), b
    assert sum(seen) < 4 * len(texts)


def test_lines_that_meet_in_blocks_are_not_copied(spark, monkeypatch):
    """All lines of like lengths are met, whatever the blocks, and no line is copied for the blocks that it meets."""
    import xxhash

    from triagelake.session import cut

    monkeypatch.setattr(lines, "BLOCK", 7)
    monkeypatch.setattr(lines, "OTHERS", 5)
    monkeypatch.setattr(lines, "MET", 60)
    rng = random.Random(23)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(20, 90))) for _ in range(60)]
    texts += ["".join(rng.choice(["", x + "e", "f"]) if rng.random() < 0.04 else x for x in rng.choice(texts)) for _ in range(90)]
    texts = [t for t in dict.fromkeys(texts) if len(t) >= 20]
    rng.shuffle(texts)
    lengths = np.array([len(t) for t in texts])
    rows = [(i, len(t), bytearray(s), t) for i, (t, s) in enumerate(zip(texts, lines.sketches(texts, lengths), strict=True))]
    table = cut(spark.createDataFrame(rows, "line_id long, length int, sketch binary, line string"))
    done = {i for i in range(len(texts)) if xxhash.xxh3_64_intdigest(str(i)) % 5 == 0}
    settled = cut(spark.createDataFrame([(i,) for i in done], "line_id long"))
    near = [any(plain.distance(a, b) <= max(len(a), len(b)) // 20 for a in texts[:i]) for i, b in enumerate(texts)]
    found = lines.settled_in_blocks(table, settled)
    assert sorted(r["line_id"] for r in found.collect()) == [i for i, yes in enumerate(near) if yes and i not in done]
    assert sum(near) > 20
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        found.explain()
    assert "MapInArrow" in out.getvalue() and "Generate" not in out.getvalue()


def test_tables_of_line_dedup_go_when_it_is_done(spark, tmp_path):
    from triagelake.session import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    texts = [f"a line of some words that stands here {i % 7} times, number {i}" for i in range(30)]
    assert lines.line_report(frame(spark, texts)).count() == 30
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_dir(spark))) - before}
    assert left <= {"lines", "repeated-lines"}


def test_edit_distances_of_many_pairs():
    rng = random.Random(9)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcé\U0001f600") for _ in range(rng.randrange(130)))
        b = "".join(rng.choice([x, x + "a", ""]) if rng.random() < 0.06 else x for x in a)
        pairs += [(a, b), (b, a[:60] + a[61:])]
    wanted = [plain.distance(a, b) <= max(len(a), len(b)) // 20 for a, b in pairs]
    assert lines.all_similar(pairs).tolist() == wanted and 0 < sum(wanted) < len(pairs)


def test_sketches_bound_the_edits():
    rng = random.Random(8)
    for _ in range(200):
        a = "".join(rng.choice("abcé\U0001f600") for _ in range(rng.randrange(1, 600)))
        b = "".join(x for x in a if rng.random() > 0.02) + "z" * rng.randrange(3)
        lengths = np.array([len(a), len(b)])
        x, y = (np.frombuffer(s, np.uint8).astype(int) for s in lines.sketches([a, b], lengths))
        assert np.abs(x - y).sum() <= 2 * plain.distance(a, b) if len(a) < 60 else np.abs(x - y).sum() <= 2 * (len(a) - len(b) + 2 * b.count("z"))


def test_distance_of_long_lines():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(60)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(60))) if rng.random() < 0.3 else a[:20] + a[23:40] + "xy" + a[41:]
        for edits in (5, 6, 9, 20):
            assert lines.within(a, b, edits) == (plain.distance(a, b) <= edits)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        for edits in (1, 2, 3):
            assert lines.within(a, b, edits) == (plain.distance(a, b) <= edits)


def test_drop_repeated_lines(spark):
    long = "a line that is long enough to be held against others"
    docs = frame(spark, [f"{long}\nx\n\nx", f"{long}!\ny", f"  {long}", None, "", "\n"]).withColumn("at", F.lit(1))
    out = lines.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    assert by_id(out, "text") == {0: (f"{long}\nx\n",), 1: ("y",), 3: (None,), 4: ("",), 5: ("\n",)}


def test_licenses(spark, awkward):
    texts = [*awkward, "MIT  License. the Apache license, general public LICENSE mit license", "Released under the MIT License.",
             "x\nThis work is LICENSED under the GNU General Public License version 3\n", "mit\nlicense", "Licensed under CC BY-NC 4.0."]
    found = by_id(
        licenses.license_report(frame(spark, texts)), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
    for i, text in enumerate(texts):
        assert found[i][:5] == plain.licenses(text)
    n = len(awkward)
    assert [found[n + k][5] for k in range(5)] == ["apache,gpl,mit", "mit", "gpl", "mit", "cc-by-nc"]
    assert found[n + 1][6] == 1.0 and found[n + 3][6] == 0.0


def test_license_join_finds_every_block(spark):
    """Prefix, length and positional filters against plain containment in all lines and windows."""
    rng = random.Random(6)
    words = [f"k{i}" for i in range(14)]
    templates = [(f"t{i}", " ".join(rng.choices(words, k=rng.randrange(3, 9)))) for i in range(6)]
    texts = ["\n".join(" ".join(rng.choice(words + ["z1", "z2"]) for _ in range(rng.randrange(14))) for _ in range(3)) for _ in range(80)]
    texts += [None, "", "k1", *texts[:2]]
    got = {(r["doc_id"], r["label"], round(r["score"], 9)) for r in licenses.notice_matches(frame(spark, texts), templates, 0.7).collect()}
    assert got == plain.notices(texts, templates, 0.7)
    assert 50 < len(got) < len(templates) * len(texts) - 50


def wrapped(words, rng, lead):
    """Words over lines of a few words, each with what starts a comment."""
    lines, at = [], 0
    while at < len(words):
        step = rng.randrange(3, 9)
        lines.append(lead + " ".join(words[at : at + step]))
        at += step
    return "\n".join(lines)


def test_licenses_wrapped_over_lines(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    rng = random.Random(7)
    texts, want = [bsd, bsd.replace("\n", "\n\n * ")], ["bsd", "bsd"]
    for label, notice in licenses.TEMPLATES[:5]:
        for lead in ("", " * ", "# "):
            words = [*sentence(rng, rng.randrange(90)).split(), *notice.split(), *sentence(rng, rng.randrange(90)).split()]
            texts.append(wrapped(words, rng, lead))
            want.append(label)
    texts.append("mit of a thing\n" + wrapped(sentence(rng, 60).split(), rng, "") + "\nreleased under the license")
    want.append("")
    found = by_id(licenses.license_report(frame(spark, texts)), "labels", "score")
    assert [found[i][0] for i in range(len(texts))] == want
    assert all((found[i][1] >= licenses.CONTAINED) == bool(label) for i, label in enumerate(want))


def test_license_sql_on_wrapped_notices(spark):
    rng = random.Random(23)
    texts = [None, "", "Released under\nthe MIT License."]
    for _, notice in licenses.TEMPLATES:
        words = [*sentence(rng, rng.randrange(120)).split(), *notice.split(), *sentence(rng, rng.randrange(120)).split()]
        for i in rng.sample(range(len(words)), len(words) // 15):
            words[i] = rng.choice(words)
        texts.append(wrapped(words, rng, "# "))
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    want = {r[0]: r[1:] for r in duckdb.sql(f"SELECT doc_id, {', '.join(names)} FROM ({LICENSES})").fetchall()}
    assert by_id(licenses.license_report(frame(spark, texts)), *names) == want


def test_every_template_is_found_wrapped_and_told_from_others(spark):
    rng = random.Random(17)
    texts = []
    for _, notice in licenses.TEMPLATES:
        words = [*sentence(rng, rng.randrange(200)).split(), *notice.split(), *sentence(rng, rng.randrange(200)).split()]
        texts.append(wrapped(words, rng, "// "))
    texts += ["Permission is hereby granted, free of charge, to nobody", None]
    found = by_id(licenses.license_report(frame(spark, texts)), "labels")
    told = {*licenses.TELLING, "mpl-2.0", "mpl-1.1", "isc", "zlib", "unlicense", "cc0-1.0", "epl-2.0", "bsl-1.0"}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        labels = found[i][0].split(",")
        assert label in labels
        assert not (told & set(labels)) - {label}, (label, labels)
    assert found[len(texts) - 2] == ("",) and found[len(texts) - 1] == ("",)


def test_token_counts(spark, awkward):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    texts = [*awkward, "<|endoftext|> a<|endoftext|>", "it's 123 we'LL \u3000x", "\u0558 \U0001f6d8 \ua7da"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    found = by_id(tokens.token_counts(frame(spark, texts), path), "n_bytes", "n_tokens")
    for i, text in enumerate(texts):
        wanted = len(library.encode(text or "", add_special_tokens=False).ids)
        assert found[i] == (len((text or "").encode()), wanted)


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "empty"), (1002, " ", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r["doc_id"]: r.asDict() for r in mixing.mix_sizes(docs).collect()}
    assert len(found) == len(rows)
    sizes = {}
    for i, text, source in rows:
        assert found[i]["size"] == len(WORD.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + found[i]["size"]
    total = 1.5 * sum(sizes.values())
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [3, 1, 2, 3, 1], strict=False))
    target, open_ = {}, set(sizes)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weights[s] / sum(weights[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    for i, _, source in rows:
        assert found[i]["source_size"] == sizes[source]
        assert found[i]["target"] == pytest.approx(target[source])
        assert found[i]["taken"] <= 2 * found[i]["size"]
    for s in sizes:
        taken = sum(found[i]["taken"] for i, _, source in rows if source == s)
        assert abs(taken - target[s]) <= 30
    assert found == {r["doc_id"]: r.asDict() for r in mixing.mix_sizes(docs.repartition(7)).collect()}
    mixed = mixing.mix(docs.withColumn("copies", F.lit(1)))
    assert mixed.columns == [*docs.columns, "copies", "epoch"]
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: f["copies"] for i, f in found.items() if f["taken"]}


def test_mixing_prefers_quality(spark):
    rows = [(i, "word " * 10 + ("| " * 90 if i % 2 else ""), "only") for i in range(2000)]
    rows += [(5000 + i, "word " * 100, f"t{i}") for i in range(2)]
    found = mixing.mix_sizes(spark.createDataFrame(rows, SCHEMA)).where("source = 'only'").collect()
    odd = [r["copies"] for r in found if r["doc_id"] % 2]
    even = [r["copies"] for r in found if r["doc_id"] % 2 == 0]
    assert sum(even) > sum(odd)


def test_urls(spark):
    rows = [
        (1, "http://a.Example.org/es/1"), (2, "https://example.org/en/12?x=/es/"), (3, "ftp://x.org"), (4, "http://x.com/fr/"),
        (5, "http://y.x.com/de/9#/fr/"), (6, "no url"), (7, None), (8, "http://com/de/"), (9, "x://notexample.org/es/"), (10, "http://h.net?a/b"),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, bound int")
    outcomes = spark.createDataFrame([(10, True), (99, False), (1, None)], "page_id long, good boolean")
    found = {r["page_id"]: tuple(r)[1:] for r in urls.url_verdicts(pages, outcomes).collect()}
    assert found == {
        1: ("a.example.org", "/es/1", "example.org/es/", "block"),
        2: ("example.org", "/en/12", "example.org/en/1", "block"),
        3: ("x.org", "", None, "allow"),
        4: ("x.com", "/fr/", "com/fr/", "allow"),
        5: ("y.x.com", "/de/9", "com/de/", "block"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("com", "/de/", "com/de/", "block"),
        9: ("notexample.org", "/es/", "org/", "allow"),
        10: ("h.net", "", None, "allow"),
    }


def test_reputation_blocks_bad_hosts_and_shrinks_small_ones(spark):
    pages = [(i, "http://bad.spam.net/x") for i in range(60)] + [(100 + i, f"http://h{i % 20}.good.net/x") for i in range(400)]
    pages += [(600, "http://bad2.spam.net/"), (601, "http://new.good.net/"), (602, "http://h1.good.net/y")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    rng = random.Random(8)
    marks = [(i, rng.random() < 0.05) for i in range(60)] + [(100 + i, rng.random() < 0.9) for i in range(400)]
    found = {r["page_id"]: r["verdict"] for r in urls.url_verdicts(df, spark.createDataFrame(marks, "page_id long, good boolean")).collect()}
    assert found[0] == "block" and found[600] == "block"
    assert found[601] == "allow" and found[602] == "allow"


def test_levels_of_hosts(spark):
    wanted = {
        "www.good.co.uk": ("good.co.uk", "co.uk"), "good.co.uk": ("good.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
        "a.github.io": ("a.github.io", "github.io"), "b.s3.amazonaws.com": ("b.s3.amazonaws.com", "s3.amazonaws.com"),
        "a.example.com:8080": ("example.com", "com"), "example.com.": ("example.com", "com"), "me:pw@x.com.au:1": ("x.com.au", "com.au"),
        "10.0.1.2": ("10.0.1.2", "10.0.1.2"), "10.0.1.2:80": ("10.0.1.2", "10.0.1.2"), "[::1]:80": ("[::1]", "[::1]"),
        "localhost": ("localhost", "localhost"), "": ("", ""),
    }
    hosts = spark.createDataFrame([(h,) for h in wanted], "host string")
    found = hosts.select("host", urls.registered_domain(F.col("host")), urls.suffix(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in found} == wanted
    own = hosts.where("host = 'www.good.co.uk'").select(urls.registered_domain(F.col("host"), ["good.co.uk"])).first()[0]
    assert own == "www.good.co.uk"
    with pytest.raises(ValueError):
        urls.suffix(F.col("host"), [f"s{i}.x" for i in range(urls.MAX_SUFFIXES + 1)])


def test_a_bad_registrant_leaves_others_under_its_suffix_alone(spark):
    pages = [(i, "http://www.spam.co.uk/x") for i in range(300)] + [(1000 + i, f"http://h{i % 30}.good{i % 6}.co.uk/x") for i in range(240)]
    pages += [(2000, "http://shop.good1.co.uk/"), (2001, "http://new.spam.co.uk:8080/")]
    marks = [(i, False) for i in range(300)] + [(1000 + i, True) for i in range(240)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    judged = urls.url_verdicts(df, spark.createDataFrame(marks, "page_id long, good boolean"))
    found = {r["page_id"]: r["verdict"] for r in judged.collect()}
    assert found[2000] == "allow" and found[1000] == "allow"
    assert found[0] == "block" and found[2001] == "block"


def test_toxicity_on_rows_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    mine = labels.where("doc_id % 4 <> 0")
    found = by_id(toxicity.toxicity_report(docs, mine), "p_low_quality", "p_toxic", "toxic")
    assert len(found) == docs.count()
    held = [(found[r["doc_id"]][2], r["toxic"]) for r in labels.where("doc_id % 4 = 0").collect()]
    clean = [t for t, y in held if not y]
    assert sum(t == bool(y) for t, y in held) >= 0.85 * len(held)
    assert sum(clean) <= 0.05 * len(clean)


def test_chain_feeds_earlier_categories(spark):
    """The second category follows the first; its words alone do not tell."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        first = i % 3 == 0
        rows.append((i, ("alpha " if first else "") + sentence(rng, 30), int(first), int(first)))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, one int, two int")
    marks = labelled.drop("text")
    chain = toxicity.fit_chain(labelled, marks, ("one", "two"))
    assert chain["weights"][1][len(chain["active"])] > 0.3
    out = by_id(toxicity.chain_probabilities(labelled.select("doc_id", "text"), chain), "p_two")
    assert all((out[i][0] > 0.5) == bool(y) for i, _, _, y in rows)
    kept = toxicity.keep_clean(labelled, chain, "two", 0.5)
    assert kept.columns == labelled.columns and kept.count() == 200
    with pytest.raises(ValueError):
        toxicity.fit_chain(labelled, marks.limit(0), ("one", "two"))


def test_toxicity_of_awkward_rows(spark):
    """Null, empty, very long, repeated texts, null and repeated ids, clashing columns, no documents."""
    rng = random.Random(3)
    rows = [(i, ("alpha " if i % 3 == 0 else "") + sentence(rng, 30)) for i in range(240)]
    rows += [(300, None), (301, ""), (302, sentence(rng, 30_000)), (303, "alpha " * 5), (303, "alpha " * 5), (None, sentence(rng, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"p_toxic": F.lit("x"), "toxic": F.lit(7), "_fold": F.lit(1)})
    labels = spark.createDataFrame([(i, int(i % 5 > 0), int(i % 3 == 0)) for i in range(240)] + [(999, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity_report(docs, labels)
    assert found.columns == ["doc_id", "p_low_quality", "p_toxic", "toxic"]
    out = found.collect()
    assert len(out) == len(rows) and all(0 <= r["p_toxic"] <= 1 for r in out)
    twice = [r["p_toxic"] for r in out if r["doc_id"] == 303]
    assert len(twice) == 2 and twice[0] == twice[1] > 0.5
    assert len({r["p_toxic"] for r in out if r["doc_id"] in (300, 301)}) == 1
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity_report(docs.limit(0), labels).dtypes == found.dtypes
    with pytest.raises(ValueError, match="no labelled rows"):
        toxicity.toxicity_report(docs, labels.limit(0))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string")
    outcomes = spark.createDataFrame([], "page_id long, good boolean")
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    for out in (
        quality.quality_report(docs), quality.quality_cascade(docs), neardup.near_duplicates(docs), neardup.drop_near_duplicates(docs),
        suffixes.byte_report(docs), suffixes.drop_repeated_bytes(docs), mixing.mix_sizes(docs), mixing.mix(docs),
        decontam.contamination_report(docs, items), decontam.decontaminate(docs, items), urls.url_verdicts(pages, outcomes),
        lines.line_report(docs), lines.drop_repeated_lines(docs), licenses.license_report(docs), tokens.token_counts(docs, path),
    ):
        assert out.count() == 0


def test_words_of_plain_versions_agree(spark, awkward):
    from triagelake.llm.words import lower_ascii, plain_words, spaced_words, whole

    rows = frame(spark, awkward).select(
        "doc_id", spaced_words(F.col("text")).alias("a"), plain_words(lower_ascii(whole(F.col("text")))).alias("b")
    )
    for i, (a, b) in by_id(rows, "a", "b").items():
        text = awkward[i] or ""
        assert a == WORD.findall(text) and b == PLAIN.findall(text.translate(plain.LOWER))


def test_crowds_are_compared_by_blocks(spark, monkeypatch):
    """Documents that share much but too little, a few linked pairs among them."""
    monkeypatch.setattr(neardup, "FEW_PAIRS", 0.0)
    monkeypatch.setattr(neardup, "CROWD_BLOCK", 5)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(120)]
    texts = [" ".join([*passage, *(f"u{i}.{k}" for k in range(26 + i % 7))]) for i in range(40)]
    texts += [t.replace(" p60 ", " q60 ", 1) for t in rng.sample(texts, 6)]
    rng.shuffle(texts)
    found = by_id(neardup.near_duplicates(frame(spark, texts)), "n_shingles", "component_id")
    assert found == plain.near_duplicates(list(enumerate(texts)))


def test_common_counts():
    import numpy as np

    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 120))) for _ in range(17)]
    got = neardup.common_counts(sets[:9], sets[9:], width=64)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[9:]] for a in sets[:9]]
