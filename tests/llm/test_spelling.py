import random
import re
import zlib
from collections import Counter

from postprism.llm import spelling

ALPHABET = "abcdefghijklmnopqrstuvwxyzàéß÷"


def shifted(text, table=str.maketrans(spelling._UPPER, spelling._LOWER)):
    return text.translate(table)


def counted(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = shifted(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {word: n for word, n in found.items() if n >= 2}


def one_edit(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + x + word[i:] for i in range(len(word) + 1) for x in letters}
    out |= {word[:i] + x + word[i + 1 :] for i in range(len(word)) for x in letters}
    return out - {word}


def brute(rows):
    n = counted(rows)
    letters = set("".join(n))
    form, near = {}, {}
    for word in n:
        others = {other for other in one_edit(word, letters) if other in n} if len(word) < 500 else set()
        near[word] = len(others)
        best = min(others, key=lambda other: (-n[other], other), default=None)
        form[word] = best if best is not None and n[best] >= 10 * n[word] else None
    out = []
    for word in n:
        root = word
        while form[root] is not None:
            root = form[root]
        out.append((word, form[word], root, n[word], near[word], n[form[word]] if form[word] else None))
    return sorted(out)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(row) for row in spelling.variants(docs).collect())
    assert got == brute(rows)
    return got


def varied(seed, words, most):
    pick = random.Random(seed)
    base = ["".join(pick.choice(ALPHABET) for _ in range(pick.randrange(6, 14))) for _ in range(words)]
    rows = []
    for i in range(120):
        line = []
        for _ in range(60):
            word = base[int(pick.random() ** 3 * words)]
            if pick.random() < 0.25:
                at = pick.randrange(len(word))
                word = pick.choice([word[:at] + word[at + 1 :], word[:at] + pick.choice(ALPHABET[:most]) + word[at:], word[:at] + pick.choice(ALPHABET[:most]) + word[at + 1 :]])
            line.append(word.upper() if pick.random() < 0.1 else word)
        rows.append((i, " ".join(line) + pick.choice(["", ". 7x", "\n"])))
    return rows


def test_equals_brute_force(spark):
    got = check(spark, varied(1, 60, 6))
    assert sum(row[1] is not None for row in got) > 50


def test_repeated_letters(spark):
    """Inserting beside an equal letter can be told in several ways; each pair counts once."""
    pick = random.Random(4)
    stems = ["".join(pick.choice("ab") for _ in range(pick.randrange(7, 10))) for _ in range(150)]
    check(spark, [(i, " ".join(pick.choices(stems, k=80))) for i in range(40)])


def test_large_buckets_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BUCKET_WORDS", 3)
    monkeypatch.setattr(spelling, "_ROWS", 50)
    monkeypatch.setattr(spelling, "_PAIRS", 64)
    pick = random.Random(5)
    stems = ["prefix" + "".join(pick.choice("abc") for _ in range(pick.randrange(3, 6))) + pick.choice(["", "ending"]) for _ in range(300)]
    check(spark, [(i, " ".join(pick.choices(stems, k=80))) for i in range(60)])


def test_more_than_one_block(spark):
    """One bucket of several hundred words of one length, all one replaced letter apart."""
    pick = random.Random(6)
    stems = ["same" + "".join(pick.choice(ALPHABET) for _ in range(2)) + "tail" for _ in range(400)]
    check(spark, [(i, " ".join(pick.choices(stems, k=100))) for i in range(40)])


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(row.doc_id, row.text) for row in odd_docs.collect()]
    rows += [(21, "q" * 60_000), (22, "q" * 60_000), (None, "Repeated repeated REPEATED"), (None, "repeatd repeated")]
    assert any(len(row[0]) == 60_000 for row in check(spark, rows))
    wide = sorted(tuple(row) for row in spelling.variants(odd_docs).collect())
    assert wide == brute([(row.doc_id, row.text) for row in odd_docs.collect()])
    empty = spelling.variants(no_docs)
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0


def test_chains_of_forms(spark):
    words = ["abcdefgh"] * 2 + ["abcdefghi"] * 30 + ["abcdefghij"] * 400
    got = check(spark, [(1, " ".join(words))])
    assert got[0][:3] == ("abcdefgh", "abcdefghi", "abcdefghij")
