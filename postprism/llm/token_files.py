"""Token ids of all documents in files in ascending key order: a wavelet matrix per file."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from postprism.llm.wavelet import WaveletMatrix, from_bytes, to_bytes
from postprism.llm.words import parts, split_words, trimmed
from postprism.session import materialise

END_ID = 1  # appended to every document
FILE_BYTES = 16 << 20  # text of a file, about
_FILE_TOKENS = 8 << 20  # a file is closed at the document that brings it to so many tokens
_CACHED = 500_000  # words a worker remembers
_TOGETHER = 512  # words given to the library at once


# Letters or digits and then signs: always cut between the two. A quote may begin a piece such as "'s", and "<" a special token.
_LETTERS = re.compile("[a-z]+")
_CORE = re.compile("([a-z0-9]+)([^a-z0-9'<]+)")


class WordEncoder:
    """Encodes texts with the library, each distinct word once: the vocabulary joins nothing across white space."""

    def __init__(self, content: str) -> None:
        self.tokenizer = Tokenizer.from_str(content)
        self.parts: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, int] = {}  # the word's number
        self.ids = np.zeros(0, dtype=np.uint32)  # of all known words, in the order of their numbers
        self.ends = np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [split_words(text) for text in texts]
        self._learn(chain.from_iterable(cut))
        counts = [len(words) for words in cut]
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=sum(counts))
        starts, lengths = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        before = np.concatenate(([0], np.cumsum(lengths)))
        places = np.arange(before[-1]) + np.repeat(starts - before[:-1], lengths)
        return np.split(self.ids[places], before[np.cumsum(counts)][:-1])

    def _learn(self, words: Iterable[str]) -> None:
        held = len(self.known)
        new = trimmed(self.known, words, _CACHED)
        if len(self.known) < held:
            self.ids, self.ends = self.ids[:0], self.ends[:1]
        halves = [self._halves(word) for word in new]
        distinct = trimmed(self.parts, chain.from_iterable(halves), _CACHED)
        # letters a to z are one piece, and their bytes stand for themselves: the library's model takes them as they are
        tokenize = self.tokenizer.model.tokenize
        simple = [word for word in distinct if _LETTERS.fullmatch(word)]
        for word in simple:
            self.parts[word] = tuple([token.id for token in tokenize(word)])
        others = [word for word in distinct if word not in self.parts]
        groups = [others[i : i + _TOGETHER] for i in range(0, len(others), _TOGETHER)]
        for group, found in zip(groups, self.tokenizer.encode_batch(groups, is_pretokenized=True, add_special_tokens=False), strict=True):
            bounds = np.searchsorted(found.word_ids, np.arange(len(group) + 1))
            own = found.ids
            for word, a, b in zip(group, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                self.parts[word] = tuple(own[a:b])
        ids = [list(chain.from_iterable(map(self.parts.__getitem__, own))) for own in halves]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum([len(own) for own in ids], dtype=np.int64)))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(ids), dtype=np.uint32)))

    @staticmethod
    def _halves(word: str) -> tuple[str, ...]:
        """What is encoded apart. The normaliser lower-cases anyway, but for special tokens."""
        if not word.isascii() or "<" in word:
            return (word,)
        lowered = word.lower()
        match = _CORE.fullmatch(lowered)
        return match.groups() if match else (lowered,)


@lru_cache(maxsize=2)
def _encoder(content: str) -> WordEncoder:
    return WordEncoder(content)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of all texts to files below ``folder`` and return their list ``(part, number, name, docs, tokens)``.

    Rows are sorted by key (NULL first; equal keys by text) over all files: ranges of about ``file_bytes`` of text, each
    one file, or several if a range holds long texts. Every document ends with END_ID; NULL is an empty text. ``folder`` is a
    location that pyarrow can write, such as a ``file:`` folder that all executors share. A file's name is unique to the attempt that
    wrote it, and only the list, itself written once, says which files count: a lost task leaves a stray file but no wrong result.
    """
    content = Path(vocabulary).read_text(encoding="utf-8")
    highest = max([END_ID, *json.loads(content)["model"]["vocab"].values(), *(t["id"] for t in json.loads(content)["added_tokens"])])
    bits = highest.bit_length()
    shared = docs.sparkSession.sparkContext.broadcast(content)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = _encoder(shared.value), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal keys, ids, held, number
            lengths = np.array([len(own) for own in ids], dtype=np.int64)
            sections = {
                "keys": np.array([value or 0 for value in keys], dtype=np.int64),
                "missing": np.packbits([value is None for value in keys]),
                "lengths": lengths,
            }
            body = to_bytes(WaveletMatrix.build(np.concatenate(ids), bits), sections)
            name = f"tokens-{part:06d}-{number:04d}-{uuid.uuid4().hex}.wm"
            target, path = fs.FileSystem.from_uri(folder)
            target.create_dir(path, recursive=True)
            with target.open_output_stream(f"{path}/{name}") as out:
                out.write(body)
            listed = pa.record_batch(
                [[part], [number], [name], [len(keys)], [int(lengths.sum())]], names=["part", "number", "name", "docs", "tokens"]
            )
            keys, ids, held, number = [], [], 0, number + 1
            return listed

        for batch in batches:
            for first, texts in parts(batch.column(1)):
                for place, own in enumerate(encoder.encode(texts)):
                    keys.append(batch.column(0)[first + place].as_py())
                    ids.append(np.append(own, np.uint32(END_ID)).astype(np.uint16 if bits <= 16 else np.uint32))
                    held += len(ids[-1])
                    if held >= _FILE_TOKENS:
                        yield close()
        if keys:
            yield close()

    order = ["key", F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)
    return materialise(sorted_rows.mapInArrow(of, "part long, number long, name string, docs long, tokens long"), "token-files")


def read_token_files(files: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """``(key, start, ids)`` of each document of the listed files: ids of all documents before it, and its own ids as
    little-endian unsigned 32-bit integers."""
    spark = files.sparkSession
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one short row per file
    known = files.select("name", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                matrix, sections = from_bytes(content.as_py())
                ids = matrix.tokens().astype("<u4")
                ends = np.cumsum(sections["lengths"])
                starts = ends - sections["lengths"]
                missing = np.unpackbits(sections["missing"], count=len(ends)).view(bool)
                for i in range(0, len(ends), 1_024):
                    bodies = [ids[a:b].tobytes() for a, b in zip(starts[i : i + 1_024], ends[i : i + 1_024], strict=True)]
                    yield pa.record_batch(
                        [
                            pa.array([name.as_py()] * len(bodies)),
                            pa.array(sections["keys"][i : i + 1_024], mask=missing[i : i + 1_024]),
                            pa.array(starts[i : i + 1_024]),
                            pa.array(bodies, pa.binary()),
                        ],
                        names=["name", "key", "start", "ids"],
                    )

    if files.isEmpty():
        return files.select(F.lit(0).cast("long").alias(key), F.lit(0).cast("long").alias("start"), F.lit(b"").alias("ids")).limit(0)
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)
    named = stored.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = named.mapInArrow(of, "name string, key long, start long, ids binary")
    return rows.join(known, "name").select(F.col("key").alias(key), (F.col("before") + F.col("start")).alias("start"), "ids")
