"""Language of texts: unigram models over a fixed vocabulary of pieces, summed over all segmentations."""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postprism.llm.words import parts, trimmed
from postprism.session import materialise

ROUNDS = 3  # of expectation and maximisation
UNSEEN = 0.01  # share of each language's probability that all pieces have alike
UNKNOWN = "und"
UNIT_BYTES = 64  # most bytes of a unit with its leading space
_CHUNK = 15  # characters of a longer word's units: at most 60 bytes
_STEP = 10  # a piece's probability is held times 2 ** (_STEP * bytes), so that no unit's product leaves the range of doubles
_COUNTED = 1 << 17  # distinct units counted in memory before they are passed on
_CACHED = 1 << 19  # units whose scores are kept
_CELLS = 1 << 18  # units times languages whose sums are taken at a time
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    """Languages in order and, for each piece and language, the scaled probability: pieces times languages numbers."""

    vocabulary: str
    languages: list[str]
    pieces: np.ndarray


class Trie:
    """The vocabulary's pieces as a tree: ``child[node, byte]`` is a node or 0, ``piece[node]`` the piece that ends there or -1."""

    def __init__(self, pieces: list[bytes]) -> None:
        numbers: dict[bytes, int] = {b"": 0}
        for piece in pieces:
            for end in range(1, len(piece) + 1):
                numbers.setdefault(piece[:end], len(numbers))
        self.child = np.zeros((len(numbers), 256), dtype=np.int32)
        for prefix, node in numbers.items():
            if node:
                self.child[numbers[prefix[:-1]], prefix[-1]] = node
        self.piece = np.full(len(numbers), -1, dtype=np.int32)
        self.piece[[numbers[piece] for piece in pieces]] = np.arange(len(pieces))
        # nodes without children share one empty row: most nodes are leaves
        inner = self.child.any(axis=1)
        inner[0] = True
        self.row = np.where(inner, np.cumsum(inner) - 1, inner.sum()).astype(np.int32)
        self.child = np.concatenate((self.child[inner], np.zeros((1, 256), dtype=np.int32)))

    def spans(self, letters: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, units, pieces) of every place where units hold a piece, by start."""
        for start in range(letters.shape[1]):
            units = np.flatnonzero(sizes > start)
            node = np.zeros(len(units), dtype=np.int32)
            for end in range(start + 1, letters.shape[1] + 1):
                inside = sizes[units] >= end
                units, node = units[inside], node[inside]
                node = self.child[self.row[node], letters[units, end - 1]]
                units, node = units[node > 0], node[node > 0]
                if not len(units):
                    break
                piece = self.piece[node]
                ends = piece >= 0
                if ends.any():
                    yield start, end, units[ends], piece[ends]


@lru_cache(maxsize=2)
def vocabulary_trie(path: str) -> Trie:
    """The pieces of a tiktoken file; they hold every single byte, so every text has a segmentation."""
    with open(path, "rb") as lines:
        return Trie([base64.b64decode(line.split()[0]) for line in lines if line.strip()])


def units(text: str) -> list[str]:
    """Lower-cased words; a word of more than UNIT_BYTES - 1 bytes is several units, of which all but the first begin with a line break."""
    words = text.lower().split()
    if not words or len(max(words, key=len)) <= _CHUNK:
        return words
    out = []
    for word in words:
        if len(word) <= _CHUNK or len(word.encode()) < UNIT_BYTES:
            out.append(word)
        else:
            out.append(word[:_CHUNK])
            out.extend("\n" + word[at : at + _CHUNK] for at in range(_CHUNK, len(word), _CHUNK))
    return out


def _letters(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [unit[1:].encode() if unit[0] == "\n" else b" " + unit.encode() for unit in some]
    sizes = np.array([len(one) for one in raw], dtype=np.int64)
    width = int(sizes.max())
    return np.frombuffer(b"".join(one.ljust(width, b"\0") for one in raw), dtype=np.uint8).reshape(len(raw), width), sizes


def _forward(letters: np.ndarray, sizes: np.ndarray, trie: Trie, pieces: np.ndarray) -> np.ndarray:
    """For each unit and language the sum over all segmentations of the products of their pieces' scaled probabilities."""
    sums = np.zeros((letters.shape[1] + 1, len(letters), pieces.shape[1]))
    sums[0] = 1
    for start, end, some, piece in trie.spans(letters, sizes):
        sums[end, some] += sums[start, some] * pieces[piece]
    return sums[sizes, np.arange(len(letters))]


def log_likelihoods(some: list[str], trie: Trie, pieces: np.ndarray) -> np.ndarray:
    """(unit, language): the logarithm of each unit's probability under each language's model."""
    out = np.empty((len(some), pieces.shape[1]))
    order = np.argsort([len(unit) for unit in some], kind="stable")  # units of about one length together
    most = max(16, _CELLS // max(1, pieces.shape[1]))
    for low in range(0, len(some), most):
        own = order[low : low + most]
        letters, sizes = _letters([some[i] for i in own])
        total = _forward(letters, sizes, trie, pieces)
        out[own] = np.log(total) - (_STEP * np.log(2.0) * sizes)[:, None]
    return out


def expected_pieces(some: list[str], weights: np.ndarray, language: np.ndarray, trie: Trie, pieces: np.ndarray) -> np.ndarray:
    """(piece, language): how often each piece is expected in the units, over all their segmentations.

    Each unit counts for its own language, ``weights`` times. Sums run forward and backward over its places.
    """
    out = np.zeros(pieces.shape)
    order = np.argsort([len(unit) for unit in some], kind="stable")
    for low in range(0, len(some), _CELLS // 16):
        own = order[low : low + _CELLS // 16]
        letters, sizes = _letters([some[i] for i in own])
        told = language[own]
        spans = list(trie.spans(letters, sizes))
        ahead = np.zeros((letters.shape[1] + 1, len(own)))
        ahead[0] = 1
        for start, end, at, piece in spans:
            ahead[end, at] += ahead[start, at] * pieces[piece, told[at]]
        total = ahead[sizes, np.arange(len(own))]
        behind = np.zeros_like(ahead)
        behind[sizes, np.arange(len(own))] = weights[own] / total
        for start, end, at, piece in reversed(spans):
            through = behind[end, at] * pieces[piece, told[at]]
            np.add.at(out, (piece, told[at]), ahead[start, at] * through)
            behind[start, at] += through
    return out


def count_units(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, unit, n)`` over all texts with a language; each task passes on what it has counted."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for name, counts in found.items():
                columns = [pa.array([name] * len(counts), type=pa.string()), pa.array(list(counts), type=pa.string()), pa.array(list(counts.values()), type=pa.int64())]
                yield pa.record_batch(columns, names=["lang", "unit", "n"])
            found.clear()

        for batch in batches:
            names = batch.column(0)
            for first, texts in parts(batch.column(1)):
                for row, one in enumerate(texts, start=first):
                    found.setdefault(names[row].as_py(), Counter()).update(units(one))
                if sum(map(len, found.values())) > _COUNTED:
                    yield from flushed()
        yield from flushed()

    told = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counted = told.mapInArrow(of, "lang string, unit string, n long")
    return counted.groupBy("lang", "unit").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang") -> Model:
    """One unigram model of the vocabulary's pieces for each language of the rows that have one.

    The distinct units of all texts are counted once. Each round finds how often every piece is expected in them, over all
    segmentations, starting from equal probabilities: each task adds up its units and passes on one row per piece and
    language, which the driver turns into probabilities. That table, of the vocabulary's size times the languages, is all that is
    sent anywhere. A text without words teaches nothing, but its language can be told.
    """
    counts = materialise(count_units(docs, text, lang), "language-units")
    languages = [row["lang"] for row in docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang")).distinct().orderBy("lang").collect()]
    trie = vocabulary_trie(vocabulary)
    total = int(trie.piece.max()) + 1
    scale = np.zeros(total)
    with open(vocabulary, "rb") as lines:
        for number, line in enumerate(line for line in lines if line.strip()):
            scale[number] = 2.0 ** (_STEP * len(base64.b64decode(line.split()[0])))
    pieces = np.repeat(scale[:, None] / total, len(languages), axis=1)
    context = counts.sparkSession.sparkContext
    for _ in range(ROUNDS if languages else 0):
        sent = context.broadcast((languages, pieces))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, current = sent.value
            number = {name: i for i, name in enumerate(names)}
            found = np.zeros(current.shape)
            for batch in batches:
                told = np.array([number[name] for name in batch.column(0).to_pylist()], dtype=np.int64)
                found += expected_pieces(batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(float), told, vocabulary_trie(vocabulary), current)
            piece, told = np.nonzero(found)
            yield pa.record_batch([pa.array(piece), pa.array(told), pa.array(found[piece, told])], names=["piece", "language", "n"])

        sums = counts.mapInArrow(expect, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n"))
        found = sums.toPandas()
        sent.destroy()
        seen = np.zeros(pieces.shape)
        seen[found["piece"].to_numpy(), found["language"].to_numpy()] = found["n"].to_numpy()
        share = seen / np.maximum(seen.sum(axis=0, keepdims=True), 1e-300)
        share = ((1 - UNSEEN) * share + UNSEEN / total).astype(np.float32)  # rounded: sums in another order give the same
        pieces = share.astype(float) * scale[:, None]
    return Model(vocabulary, languages, pieces)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the likeliest language of the text and its probability among all.

    All languages are equally likely beforehand; of equally likely ones the first by name counts. A text that is NULL or has no letter, or any text
    where no language was learned, is UNKNOWN with score 0.
    """
    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in docs.schema if field.name not in ("lang_pred", "score"))
    names = [field.name for field in docs.schema if field.name not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        trie, cache = vocabulary_trie(model.vocabulary), {}
        known = np.zeros((0, len(model.languages)))
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for _, texts in parts(batch.column(batch.schema.get_field_index("_text"))):
                asked = [units(one) if model.languages and _LETTER.search(one) else [] for one in texts]
                new = trimmed(cache, (unit for own in asked for unit in own), _CACHED)
                if not cache:  # empty at first and when it was full
                    known = known[:0]
                if new:
                    cache.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    known = np.concatenate((known, log_likelihoods(new, trie, model.pieces)))
                for own in asked:
                    if not own:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    total = known[[cache[unit] for unit in own]].sum(axis=0)
                    best = int(total.argmax())
                    langs.append(model.languages[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.record_batch([*columns, pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.select(*names, F.col(text).alias("_text")).mapInArrow(of, f"{kinds}, lang_pred string, score double")

