import html
import re

import pytest
from rowtools import as_tuples
from pyspark.sql import functions as F

from postprism.functions.text import (
    ROLE_TERMS,
    WHITE_SPACE,
    classify_title,
    clean_text,
    joined,
    matches_role,
    strip_markup,
)

TEXTS = [
    None,
    "",
    "   ",
    "\t\n",
    " a b ",
    " x ",
    "<p>One &amp; two</p>",
    "&lt;b&gt; stays &amp;lt;",
    "&#65;&#x42;&copy2023 &nbsp;",
    "a < b and c > d",
    "<p\nclass='x'>line</p> end ",
    "no markup",
    "&middot; &hellip; &unknown; &",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, text) for i, text in enumerate(TEXTS)], "i int, t string").repartition(3)


def by_number(df):
    return [row[1] for row in sorted(as_tuples(df))]


def test_white_space_is_complete():
    assert set(WHITE_SPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_clean_text(texts):
    got = by_number(texts.select("i", clean_text(F.col("t"))))
    assert got == [(text or "").strip() or None for text in TEXTS]


def test_strip_markup(texts):
    got = by_number(texts.select("i", strip_markup(F.col("t"))))
    assert got == [html.unescape(re.sub(r"<[^>]+>", " ", text or "")).strip() for text in TEXTS]


def test_joined(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "xs array<string>")
    assert [row[0] for row in as_tuples(df.select(joined(F.col("xs"))))] == ["a|b", None, None]


TITLES = [
    None,
    "",
    "Senior Data Analyst",
    "Analyst",
    "Analysts wanted",
    "Web analytics lead",
    "Business   Intelligence",
    "BI Developer (m/w/d)",
    "data engineer/ops",
    "preanalyst",
    "éanalyst",
    "analyst_2",
    "ANALYST-2",
    "Head of Business Intelligence and Data Science",
    "Data Scientist",
    "Business Analyst / Data Engineer",
    "Catalytic chemist",
    "Analyste",
]


def test_role_terms_and_rules(spark):
    df = spark.createDataFrame([(i, title) for i, title in enumerate(TITLES)], "i int, t string")
    pattern = re.compile(r"\b(" + "|".join(ROLE_TERMS) + r")\b", re.I)
    got = by_number(df.select("i", F.coalesce(matches_role(F.col("t")), F.lit(False))))
    assert got == [bool(title and pattern.search(title)) for title in TITLES]

    roles = dict(zip(TITLES, by_number(df.select("i", classify_title(F.col("t")))), strict=True))
    assert roles["Senior Data Analyst"] == "Data Analyst"
    assert roles["BI Developer (m/w/d)"] == "Business Analyst"
    assert roles["Business Analyst / Data Engineer"] == "Business Analyst"
    assert roles["data engineer/ops"] == "Data Engineer"
    assert roles["Web analytics lead"] == "Data Analyst"
    # Contains, not whole word: the broad last rule.
    assert roles["Catalytic chemist"] == "Other"
    assert roles["Analyste"] == "Data Analyst"
    assert roles["Head of Business Intelligence and Data Science"] == "Business Analyst"


def test_rules_are_an_argument(spark):
    df = spark.createDataFrame([("x-ray",), ("yes",), ("no",)], "t string")
    got = as_tuples(df.select(classify_title(F.col("t"), [("x", "X"), ("y", "Y")], other="none")))
    assert got == [("X",), ("Y",), ("none",)]
    assert as_tuples(df.select(classify_title(F.col("t"), [])).distinct()) == [("Other",)]


def test_only_references_reach_the_helper(spark):
    """Memory of the Python workers follows the references, not the texts."""
    from postprism.functions import text

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def watched(lists):
        seen.add(sum(len(one) for references in lists if references is not None for one in references))
        return lists.map(lambda references: [html.unescape(one) for one in references], na_action="ignore")

    texts = ["word " * 5_000 + "a &amp; b &#x41;&#66 &notit; &unknown; && &", "&lt;", "&#32;", "plain", None, "x &amp;lt; y\r&eacute\r"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    kept, text._decode_references = text._decode_references, watched
    try:
        got = {row.i: row.t for row in rows.select("i", strip_markup(F.col("t")).alias("t")).collect()}
    finally:
        text._decode_references = kept
    assert got == {i: html.unescape(t or "").strip() for i, t in enumerate(texts)}
    assert 0 < seen.value < 100
