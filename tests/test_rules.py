import pytest
from pyspark.sql import functions as F

from triagelake.functions import rules, text
from triagelake.functions.vocabulary import CATEGORY_KEYWORDS, LABEL_CATEGORIES
from triagelake.operators.classify import classify


def test_vocabulary_sizes():
    assert [len(CATEGORY_KEYWORDS[c]) for c in CATEGORY_KEYWORDS] == [14, 14, 14, 14, 16, 18, 16, 14, 18]
    assert len(LABEL_CATEGORIES) == 24
    assert all(w == w.lower() for words in CATEGORY_KEYWORDS.values() for w in words)


def test_labels(spark):
    cases = [
        (["performance"], "latency"), (["bug"], "outage"), (["security"], "security"), (["PERFORMANCE"], "latency"),
        (["enhancement", "performance", "bug"], "latency"), (["unknown-label", "random"], "unknown"), ([], "unknown"),
        ([""], "latency"), (["a"], "latency"), (["area/networking"], "network"), (None, "unknown"), ([None, "bug"], "outage"),
        (["x", "dns-thing"], "network"), (["release", "bug"], "deployment"),
    ]
    df = spark.createDataFrame([(i, l) for i, (l, _) in enumerate(cases)], "i int, labels array<string>")
    got = [r["c"] for r in df.orderBy("i").select(rules.category_from_labels("labels").alias("c")).collect()]
    assert got == [c for _, c in cases]


TEXTS = [
    ("Pages load with latency, p99 doubled, response time poor", "latency", 1.0),
    ("Checkout crash, site down, nothing but 503", "outage", 1.0),
    ("A breach through a known CVE, maybe an exploit", "security", 1.0),
    ("The cat sat on the mat", "unknown", 0.0),
    ("SOME LATENCY AT NOON", "latency", 1 / 3),
    ("flag", "latency", 1 / 3),  # lag before flag: the first category wins a tie
    ("", "unknown", 0.0),
    ("latency latency latency", "latency", 1 / 3),  # a repeated word counts once
    ("ssl", "security", 1 / 3),
]


@pytest.mark.parametrize("engine", ["scan", "expr"])
def test_text(spark, engine):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)], "i int, t string")
    got = df.orderBy("i").select(rules.category_from_text("t", engine).alias("c")).select("c.*").collect()
    assert [r["category"] for r in got] == [c for _, c, _ in TEXTS]
    assert [r["confidence"] for r in got] == pytest.approx([c for _, _, c in TEXTS])


def test_engines_agree_on_every_keyword_pair(spark):
    words = sorted({w for ws in CATEGORY_KEYWORDS.values() for w in ws})
    texts = [(f"{a} and {b}X",) for i, a in enumerate(words) for b in words[i % 7 :: 11]]
    df = spark.createDataFrame(texts, "t string")
    a, b = rules.category_from_text("t", "scan"), rules.category_from_text("t", "expr")
    assert df.select(a.alias("a"), b.alias("b")).filter("a <> b").count() == 0


def test_without_the_automaton_expressions_stand_in(spark, monkeypatch):
    monkeypatch.setattr(rules, "find_spec", lambda name: None)
    df = spark.createDataFrame([(t,) for t, _, _ in TEXTS], "t string").select(rules.category_from_text("t").alias("c"))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()
    assert [r["c"]["category"] for r in df.collect()] == [c for _, c, _ in TEXTS]


def test_unknown_engine():
    with pytest.raises(ValueError):
        rules.category_from_text("t", "other")


def test_severity(spark):
    cases = [
        ("x", "URGENT fix", "critical"), ("Data loss", "", "high"), ("slow", "x", "medium"), ("typo", "x", "low"),
        ("nothing", "here", "medium"), ("following", "allowed", "low"), ("high", "all users", "critical"),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, title string, description string")
    got = [r["s"] for r in df.orderBy("i").select(rules.estimate_severity().alias("s")).collect()]
    assert got == [c[2] for c in cases]


def test_text_projections(spark):
    df = spark.createDataFrame(
        [("T", "D", "R"), ("T", "D", ""), ("T", "", None)], "title string, description string, resolution string"
    )
    got = [r["e"] for r in df.select(text.embedding_text().alias("e")).collect()]
    assert got == ["T D Resolution: R", "T D", "T "]
    assert [r["h"] for r in df.select(text.has_resolution().alias("h")).collect()] == [True, False, False]


def test_title_key(spark):
    df = spark.createDataFrame([("\t Ab C \x1f",), ("ab c",), (" \n",)], "title string")
    assert [r["k"] for r in df.select(text.title_key().alias("k")).collect()] == ["ab c", "ab c", ""]


def test_two_decimals_like_python(spark):
    values = [0.125, 0.375, 0.145, 0.155, 0.165, 0.005, 0.015, 0.0, 1.0, 0.999999, 0.295, 1e-9, 0.0049999999]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["s"] for r in df.orderBy("i").select(text.two_decimals("v").alias("s")).collect()]
    assert got == [f"{v:.2f}" for v in values]


def test_classify(spark):
    df = spark.createDataFrame([("api is down", "503 for all users")], "title string, description string")
    row = classify(df).first()
    assert (row["predicted_category"], row["predicted_severity"]) == ("outage", "critical")
    assert row["category_confidence"] == pytest.approx(2 / 3)
    assert classify(df, engine="expr").drop("x").first() == row
    assert F  # columns only
