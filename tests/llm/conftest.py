import random

import pytest

WORDS = "the of and river stone cloud paper green walks under seven moon table window garden silver morning letter Über straße".split()


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(40)) * (pick.random() < 0.3) for _ in range(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs, empty and long texts, repeated rows, and further columns named like the operators' own."""
    long = prose(1, 20_000)
    rows = [
        (1, prose(2, 150), "en"),
        (2, prose(2, 150), "en"),
        (2, prose(2, 150), "en"),
        (3, None, None),
        (4, "", "de"),
        (None, prose(3, 90), "fr"),
        (5, long, None),
        (6, long + " x", "en"),
        (7, "\x00\x1c\x85 </s> <|endoftext|>a Σ İ 'll 12 — ﬁ", "en"),
        (8, prose(4, 120) + "\n\n" + prose(2, 150), "en"),
        (9, " \n\t ", "en"),
        (10, "aaaa " * 2_000, "en"),
    ]
    extra = "key long, node long, text_id long, value string, spans string, score double, shard int, size long, region string, component long"
    shaped = [(*row, 1, 2, 3, "v", "s", 0.5, 1, 9, "r", 4) for row in rows]
    return spark.createDataFrame(shaped, f"doc_id long, text string, lang string, {extra}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def smallest_reachable(nodes, linked):
    """Brute force: node -> smallest node reachable over linked pairs."""
    parent = {node: node for node in nodes}

    def top(node):
        while parent[node] != node:
            node = parent[node]
        return node

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if linked(a, b):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {node: top(node) for node in nodes}
