import random

import numpy as np
import pytest

from postprism.llm import decontaminate
from tests.llm.conftest import prose


def words(text):
    return decontaminate.word_hashes([text or ""])[0][:-1]


def brute_edits(region, item):
    row = [0] * (len(region) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(region, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


@pytest.mark.parametrize("seed", range(5))
def test_edit_distance(seed):
    pick = random.Random(seed)
    for _ in range(60):
        region, item = ([pick.randrange(4) for _ in range(pick.randrange(size))] for size in (25, 12))
        edits, begin, end = decontaminate.edits_within(np.array(region), np.array(item))
        assert edits == brute_edits(region, item)
        stretch = region[begin:end]
        full = list(range(len(stretch) + 1))
        for i, x in enumerate(item, 1):
            last, full[0] = full[0], i
            for j, y in enumerate(stretch, 1):
                last, full[j] = full[j], min(full[j] + 1, full[j - 1] + 1, last + (x != y))
        assert full[-1] == edits


def test_words_do_not_depend_on_their_place():
    hashed, begins = decontaminate.word_hashes(["One, two!", "", "zwölf two one"])
    assert begins.tolist() == [0, 3, 4, 8] and (hashed == 0).tolist() == [False, False, True, True, False, False, False, True]
    assert hashed[0] == hashed[6] and hashed[1] == hashed[5]


def edited(text, share, seed):
    pick, out = random.Random(seed), text.split(" ")
    for _ in range(int(share * len(out))):
        at = pick.randrange(len(out))
        out[at : at + 1] = pick.choice([["changed"], [], [out[at], "added"]])
    return " ".join(out)


def capitals(text):
    return "".join(char if char == "ß" else char.upper() for char in text)  # whose capitals would be two letters


def items_and_docs(spark):
    items = [(i, prose(1_000 + i, 15 + 3 * i)) for i in range(40)] + [(90, "only five words in here"), (91, "Paper"), (92, prose(5, 300))]
    docs, planted = [], {}
    for i in range(240):
        item, share = i % 40, [0, 0.05, 0.1, None][i // 40 % 4]
        middle = "" if share is None else edited(items[item][1], share, i)
        docs.append((i, f"{prose(2_000 + i, i % 50)} {capitals(middle) if i % 5 == 0 else middle}. {prose(3_000 + i, 40)}"))
        if share is not None:
            planted[i, item] = share
    docs += [(500, "x Only, five WORDS - in here."), (501, "only five words here"), (502, prose(9, 50) + " " + prose(5, 300))]
    return (
        spark.createDataFrame(items, "item_id long, text string"),
        spark.createDataFrame(docs, "doc_id long, text string"),
        planted,
        dict(items),
        dict(docs),
    )


def test_recall_and_no_false_pair(spark):
    items, docs, planted, texts, bodies = items_and_docs(spark)
    out = {(row.doc_id, row.item_id): row.edits for row in decontaminate.leaks(docs, items).collect()}
    exact = [pair for pair, share in planted.items() if share == 0]
    assert all(out[pair] == 0 for pair in exact)
    near = [pair for pair, share in planted.items() if share]
    assert sum(pair in out for pair in near) >= 0.95 * len(near)
    for (doc, item), edits in out.items():
        assert edits == brute_edits(words(bodies[doc]).tolist(), words(texts[item]).tolist()) <= 0.2 * len(words(texts[item]))
    assert (500, 90) in out and (501, 90) not in out and (502, 92) in out


def test_clean_documents_stay(spark):
    items, docs, planted, _, _ = items_and_docs(spark)
    some = items.where("item_id <> 91")
    kept = {row.doc_id for row in decontaminate.clean(docs, some).collect()}
    assert kept >= {i for i in range(240) if i // 40 % 4 == 3} and not kept & {doc for (doc, _), share in planted.items() if share == 0}


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, prose(2, 60)), (1, prose(2, 60)), (2, None), (3, ""), (None, prose(3, 30)), (4, "..")], "item_id long, text string")
    found = decontaminate.leaks(odd_docs, items)
    got = {(row.doc_id, row.item_id) for row in found.collect()}
    assert {(1, 1), (2, 1), (8, 1), (None, None)} <= got and found.count() == len(got)
    kept = decontaminate.clean(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.count() - 5  # documents 1, 2 twice, 8 and the one without an id
    assert decontaminate.leaks(no_docs, items).count() == 0 and decontaminate.clean(odd_docs, items.limit(0)).count() == odd_docs.count()


@pytest.mark.parametrize("size", [7, 10, 15, 20, 35, 36, 67, 131])
def test_no_item_is_missed_at_the_limit(spark, size):
    pick, most = random.Random(size), int(size * decontaminate.EDIT_SHARE)
    word = lambda: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    items = [(i, " ".join(word() for _ in range(size))) for i in range(25)]
    docs = []
    for i, text in items:
        own = text.split(" ")
        for at in sorted(pick.sample(range(size), most), reverse=True):
            own[at : at + 1] = pick.choice([[word()], [], [own[at], word()]])
        docs.append((i, " ".join([*(word() for _ in range(pick.randrange(40))), *own, *(word() for _ in range(30))])))
    out = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(row.doc_id, row.item_id): row.edits for row in out.collect()}
    assert found == {(i, i): brute_edits(words(docs[i][1]).tolist(), words(items[i][1]).tolist()) for i in range(25)}
