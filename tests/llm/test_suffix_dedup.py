import random
from collections import Counter

import numpy as np
import pytest

from postprism.llm import suffix_dedup
from tests.llm.conftest import prose


def brute(texts, length=suffix_dedup.LENGTH):
    counts = Counter(text[i : i + length] for text in texts for i in range(len(text) - length + 1))
    out = []
    for text in texts:
        covered = np.zeros(len(text) + 1, dtype=int)
        for i in range(len(text) - length + 1):
            if counts[text[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        out.append(np.cumsum(covered[:-1]) > 0)
    return out


def check(docs):
    rows = [(row.doc_id, (row.text or "").encode()) for row in docs.select("doc_id", "text").collect()]
    expected = sorted(str((key, len(text), bytes(np.frombuffer(text, np.uint8)[~gone]))) for (key, text), gone in zip(rows, brute([t for _, t in rows])))
    out = suffix_dedup.remove_repeats(docs).collect()
    assert sorted(str((row.doc_id, row.n_bytes, bytes(row.kept))) for row in out) == expected
    for row in out:
        ends = [(span.begin, span.end) for span in row.spans]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:])) and sum(b - a for a, b in ends) == row.n_bytes - len(row.kept)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    pick = random.Random(seed)
    texts = [bytes(pick.choice(b"ab\0\xff") for _ in range(pick.randrange(80))) for _ in range(pick.randrange(1, 6))]
    suffixes, symbols = suffix_dedup.suffix_array(texts)
    flat = [text[i:] for text in texts for i in range(len(text) + 1)]
    ordered = [flat[i] for i in suffixes]
    assert ordered == sorted(flat)
    shared = suffix_dedup.common_prefixes(suffixes, symbols)
    for a, b, got in zip(ordered, ordered[1:], shared[1:]):
        assert got == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_equals_brute_force(odd_docs):
    check(odd_docs)


def passages(spark):
    passage, pick = prose(70, 120), random.Random(6)
    rows = [(i, prose(100 + i, pick.randrange(90)) + " " + passage[: pick.choice([380, 399, 400, 401, 700])] + " " + prose(200 + i, pick.randrange(90))) for i in range(60)]
    rows += [(100 + i, prose(90, 200) if i < 5 else prose(90, 200)[: 600 + i] + "!" + prose(91, 30)) for i in range(12)]
    rows += [(200, "ab" * 3_000), (201, "x" * 900), (202, "x" * 399), (203, prose(90, 200)[:400])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_passages_at_every_edge(spark):
    check(passages(spark))


def test_hot_values_and_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 6)
    check(passages(spark))


def test_long_texts_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_RUN", 50)
    parts = suffix_dedup.stretches([prose(1, 900).encode()])
    assert (parts[3] - parts[2]).max() < 50
    text = prose(1, 400_000).encode()  # beyond one part
    batch = type("Batch", (), {"num_rows": 1, "column": lambda self, i: [[_Value(7)], [_Value(text)]][i]})()
    pieces = [piece for group in suffix_dedup._pieces(batch) for piece in group]
    starts = [place for part, _, offset in pieces for place in range(offset, offset + len(part) - suffix_dedup.LENGTH + 1)]
    assert len(pieces) > 1 and starts == list(range(len(text) - suffix_dedup.LENGTH + 1))


class _Value:
    def __init__(self, value):
        self.value = value

    def as_py(self):
        return self.value


def test_no_rows(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
