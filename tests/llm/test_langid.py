import base64
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postprism.llm import catalog, langid

SPEECH = {
    "de": "der die und nicht über straße grün wir haben einen schönen garten mit vielen blumen gesehen",
    "en": "the and of not over street green we have seen a beautiful garden with many flowers in it",
    "fr": "le la et pas sur la rue verte nous avons vu un très beau jardin avec beaucoup de fleurs",
}


@pytest.fixture(scope="module")
def pieces():
    with open(catalog.PIECES, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines]


def rows(seed, n, first=0):
    pick = random.Random(seed)
    out = []
    for i in range(first, first + n):
        lang = pick.choice(sorted(SPEECH))
        out.append((i, " ".join(pick.choices(SPEECH[lang].split(), k=pick.randrange(3, 30))), lang))
    return out


def plain_units(text):
    out = []
    for word in text.lower().split():
        if len(word.encode()) < 64:
            out.append(b" " + word.encode())
        else:
            out.append(b" " + word[:15].encode())
            out += [word[at : at + 15].encode() for at in range(15, len(word), 15)]
    return out


def segmentations(raw, pieces):
    """Every way to cut the bytes into pieces."""
    if not raw:
        yield ()
    for end in range(1, len(raw) + 1):
        if raw[:end] in pieces:
            for rest in segmentations(raw[end:], pieces):
                yield (raw[:end], *rest)


def test_forward_sums_all_segmentations(pieces):
    pick = random.Random(1)
    probability = {piece: [pick.random() / 1000 for _ in range(2)] for piece in pieces}
    scaled = np.array([[p * 2.0 ** (langid._STEP * len(piece)) for p in probability[piece]] for piece in pieces])
    some = ["the", "straße", "nicht", "ü", "x9!", "\nending", "漢字"]
    got = langid.log_likelihoods(some, langid.vocabulary_trie(catalog.PIECES), scaled)
    for unit, row in zip(some, got, strict=True):
        raw = unit[1:].encode() if unit[0] == "\n" else b" " + unit.encode()
        for which in range(2):
            total = sum(math.prod(probability[piece][which] for piece in cut) for cut in segmentations(raw, probability))
            assert row[which] == pytest.approx(math.log(total), abs=1e-9)


def test_expected_pieces(pieces):
    number = {piece: i for i, piece in enumerate(pieces)}
    scaled = np.array([[2.0 ** (langid._STEP * len(piece)) / (1 + i % 50 + 3 * which) for which in range(2)] for i, piece in enumerate(pieces)])
    some, weights, told = ["the", "und", "garden", "the"], np.array([3.0, 1.0, 2.0, 5.0]), np.array([0, 1, 0, 1])
    got = langid.expected_pieces(some, weights, told, langid.vocabulary_trie(catalog.PIECES), scaled)
    wanted = np.zeros_like(scaled)
    for unit, n, which in zip(some, weights, told, strict=True):
        cuts = list(segmentations(b" " + unit.encode(), number))
        chance = [math.prod(scaled[number[piece], which] for piece in cut) for cut in cuts]
        for cut, one in zip(cuts, chance, strict=True):
            for piece in cut:
                wanted[number[piece], which] += n * one / sum(chance)
    assert np.allclose(got, wanted)


def test_units_cover_long_words():
    text = "Straße " + "xY漢" * 4_000 + "\n" + "a" * 63 + " " + "b" * 64
    raw = [unit[1:].encode() if unit[0] == "\n" else b" " + unit.encode() for unit in langid.units(text)]
    assert raw == plain_units(text) and max(map(len, raw)) <= langid.UNIT_BYTES


def test_held_out_accuracy(spark, tmp_path):
    docs = spark.createDataFrame(rows(3, 400), "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {row.doc_id: row for row in catalog.op12_language_id(spark, str(tmp_path)).collect()}
    told = {row.doc_id: row.lang for row in docs.collect()}
    held = [i for i in told if got[i].held_out]
    assert len(got) == 400 and 50 < len(held) < 110
    assert sum(got[i].lang_pred == told[i] for i in held) >= 0.98 * len(held)
    assert all(1 / 3 <= row.score <= 1 for row in got.values())


def test_given_tables(spark, folder):
    got = catalog.op12_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").toPandas()
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95


def test_inputs_are_not_the_label(spark):
    """A text's prediction does not depend on its own row's language, key or source."""
    model = langid.fit(spark.createDataFrame(rows(5, 200), "doc_id long, text string, lang string"), catalog.PIECES)
    asked = spark.createDataFrame([(9, SPEECH["fr"], "de", "s"), (None, SPEECH["fr"], None, "t")], "doc_id long, text string, lang string, source string")
    first, second = langid.predict(asked, model).collect()
    assert first.lang_pred == second.lang_pred == "fr" and first.score == second.score


def test_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs, catalog.PIECES)
    assert model.languages == ["de", "en", "fr"]
    found = langid.predict(odd_docs, model)
    assert found.columns == [name for name in odd_docs.columns if name != "score"] + ["lang_pred", "score"]
    got = {(row.doc_id, row.lang): (row.lang_pred, row.score) for row in found.collect()}
    assert found.count() == odd_docs.count()
    assert got[3, None] == got[4, "de"] == got[9, "en"] == ("und", 0.0) and got[5, None][0] == "en" and got[None, "fr"][0] == "fr"
    none = langid.fit(no_docs, catalog.PIECES)
    assert none.languages == [] and langid.predict(no_docs, none).count() == 0
    assert {(row.lang_pred, row.score) for row in langid.predict(odd_docs, none).collect()} == {("und", 0.0)}
    unlabelled = langid.fit(odd_docs.withColumn("lang", F.lit(None).cast("string")), catalog.PIECES)
    assert unlabelled.languages == []
    one = langid.fit(odd_docs.where("lang = 'fr'"), catalog.PIECES)
    assert [tuple(row) for row in langid.predict(odd_docs.where("doc_id = 1"), one).select("lang_pred", "score").collect()] == [("fr", 1.0)]


def test_small_caches_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(rows(7, 120), "doc_id long, text string, lang string")
    model = langid.fit(docs, catalog.PIECES)
    want = sorted(tuple(row) for row in langid.predict(docs, model).collect())
    for name, value in (("_CACHED", 40), ("_COUNTED", 3), ("_CELLS", 64)):
        monkeypatch.setattr(langid, name, value)
    again = langid.fit(docs.repartition(7), catalog.PIECES)
    assert np.allclose(again.pieces, model.pieces, rtol=1e-5)
    got = sorted(tuple(row) for row in langid.predict(docs.repartition(3), again).collect())
    assert [row[:4] for row in got] == [row[:4] for row in want] and np.allclose([row[4] for row in got], [row[4] for row in want], atol=1e-4)
