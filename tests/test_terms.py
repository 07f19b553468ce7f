import random
import re

import pytest
from rowtools import as_tuples

from postprism.operators.terms import AMBIGUOUS, extract_terms, usable_vocabulary

TERMS = [
    "sql", "mysql", "sql server", "c++", "c#", ".net", "node.js", "node", "js", "power bi", "asp.net core",
    "++", "#", "é", "café", "f#", "t-sql", "ms access", "r&d", "go.", "*", "İot", "k8s", "a.b.c", "c", "\\E", "x\\Ey",
]
PIECES = TERMS + [
    " ", " ", ",", ".", "+", "#", "-", "/", "\n", "SQL", "MySQL", "Node.JS", "C++", "É", "CAFÉ", "x", "7", "(", ")",
    "K8S", "iot", "K8s", "über",
]


LETTERS = set("abcdefghijklmnopqrstuvwxyz0123456789")
SAME = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}  # letters that match an ASCII one case-blind


def fold(text):
    return "".join(SAME.get(char, char.lower()) for char in text)


def occurs(text, term):
    """Whether some place holds the term with neither a letter, digit or sign of a name before it nor after it."""
    text, term = fold(text), fold(term)
    for at in range(len(text) - len(term) + 1):
        if text.startswith(term, at):
            before, after = text[at - 1 : at] if at else "", text[at + len(term) : at + len(term) + 1]
            if before not in LETTERS | set("+#.") and after not in LETTERS | set("+#"):
                return True
    return False


def brute(texts, terms):
    return {
        (number, skill)
        for number, text in texts
        for skill, term in terms
        if text is not None and number is not None and occurs(text, term)
    }


@pytest.fixture(scope="module")
def data(spark):
    draw = random.Random(3)
    texts = [(i, "".join(draw.choice(PIECES) for _ in range(draw.randrange(0, 25)))) for i in range(600)]
    texts += [(9000, None), (9001, ""), (9002, "sql.sql sql+ sql"), (9003, ".sql"), (9004, "sql#"), (9005, "sql.")]
    texts += [(None, "sql server"), (9006, "power bi"), (9006, "power bi"), (9006, "c++ sql server")]
    terms = list(enumerate(TERMS, 1))
    frames = (
        spark.createDataFrame(texts, "doc long, text string").repartition(3),
        spark.createDataFrame(terms, "skill_id long, skills string"),
    )
    return texts, terms, *frames


@pytest.mark.parametrize("broadcast_terms", [1000, 3])
def test_equals_every_text_against_every_term(data, broadcast_terms):
    """Both ways, below and above the broadcast bound, give the result of the direct comparison."""
    texts, terms, text_frame, term_frame = data
    got = as_tuples(extract_terms(text_frame, term_frame, "doc", broadcast_terms=broadcast_terms))
    assert len(got) == len(set(got))
    assert set(got) == brute(texts, terms)


def test_terms_with_letters_only_need_no_sign_tokens(spark, data):
    texts, terms, text_frame, _ = data
    some = [(i, term) for i, term in terms if re.search("[A-Za-z0-9]", term)]
    got = extract_terms(text_frame, spark.createDataFrame(some, "skill_id long, skills string"), "doc")
    assert set(as_tuples(got)) == brute(texts, some)


def test_one_token_terms_move_no_text(spark, data):
    _, _, text_frame, _ = data
    words = spark.createDataFrame([(1, "sql"), (2, "node"), (3, "js")], "skill_id long, skills string")
    plan = extract_terms(text_frame, words, "doc")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Cartesian" not in plan
    assert not any("_folded" in line for line in plan.splitlines() if "Exchange" in line)


def test_usable_vocabulary(spark):
    words = ["r", "go", "c++", "c#", "sql", "js", "é", "ss", "7z", "word", "ab1", "x"]
    frame = spark.createDataFrame([(i, word) for i, word in enumerate(words)], "skill_id long, skills string")
    got = {row[1] for row in as_tuples(usable_vocabulary(frame))}
    assert got == {w for w in words if w not in AMBIGUOUS and not (len(w) < 3 and w.isalpha())}


@pytest.mark.parametrize("broadcast_terms", [1_000, 0])
def test_texts_are_read_once(spark, data, broadcast_terms):
    """Also where the vocabulary holds terms of one word and of several."""
    _, terms, text_rows, term_rows = data
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    rows = text_rows.count()
    extract_terms(text_rows.mapInPandas(counted, text_rows.schema), term_rows, "doc", broadcast_terms=broadcast_terms).collect()
    assert any(" " in term for _, term in terms) and read.value == rows
