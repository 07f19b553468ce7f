"""SimHash near-copies: Golay-code keys of fingerprint segments, joined and verified bit by bit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postprism.llm.buckets import groups_in_buckets
from postprism.session import materialise

WORDS = 3  # words of a shingle
SEED = 42  # of XXH64
BITS = 2  # most differing bits of a link
_PIECE = 1 << 16  # shingles hashed at a time, so that a very long text needs no more memory

# The binary Golay code's length, message bits and generator polynomial.
_LENGTH, _MESSAGE, _GENERATOR = 23, 12, 0b101011100011
_LANES = np.uint64(0x0101010101010101)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``(key, fingerprint)`` for each row: 64 majority bits over the XXH64 values of the text's word shingles.

    A-Z are lower-cased; words are runs of bytes other than space and 09-0D; shingles are ``words`` words joined by
    one space, repeats included. A text of fewer words is one shingle; without words, or NULL, the fingerprint is 0. The
    fingerprint is the unsigned value as a signed long. Other columns are left out; a repeated row gives a row each time.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_fingerprint(value or b"", words) for value in _each(batch.column(1))]
            yield pa.record_batch(
                [batch.column(0), pa.array(np.array(values, dtype=np.uint64).view(np.int64), type=pa.int64())],
                names=["key", "fingerprint"],
            )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(of, "key long, fingerprint long").select(F.col("key").alias(key), "fingerprint")


def _each(column: pa.Array) -> Iterator[bytes | None]:
    for value in column:  # one at a time: a batch's texts are not copied at once
        yield value.as_py()


def _fingerprint(text: bytes, words: int) -> int:
    parts = text.lower().split()  # bytes: only A-Z change, and only 09-0D and space split
    if not parts:
        return 0
    words = min(words, len(parts))
    joined = b" ".join(parts)
    ends = np.cumsum([len(part) + 1 for part in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), _PIECE):
        values = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _PIECE], ends[i : i + _PIECE], strict=True)]
        counts += _bit_counts(np.array(values, dtype=np.uint64))
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def _bit_counts(values: np.ndarray) -> np.ndarray:
    """How many values have each of the 64 bits: eight counters of a byte side by side, emptied every 255 values."""
    begins = np.arange(0, len(values), 255)
    counts = np.empty((8, 8), dtype=np.int64)
    for shift in range(8):
        lanes = np.add.reduceat((values >> np.uint64(shift)) & _LANES, begins)
        counts[:, shift] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.ravel()  # byte k, bit j: bit 8 k + j


class Golay:
    """The perfect (23, 12) code: every 23-bit word lies within three bits of exactly one codeword.

    Two words at most two bits apart have a word within one bit of both. So the codewords of a word and of its 23
    neighbours always include one that the other word's do too: those codewords' messages are the word's keys. There are
    one or six of them.
    """

    def __init__(self) -> None:
        self.remainders = np.array([self._remainder(1 << i) for i in range(_LENGTH)], dtype=np.int64)
        singles = 1 << np.arange(_LENGTH, dtype=np.int64)
        a, b, c = np.ogrid[:_LENGTH, :_LENGTH, :_LENGTH]
        errors = (singles[a] | singles[b] | singles[c]).ravel()  # one to three bits, as indices may be equal
        remainders = self.remainder(errors)
        self.error = np.zeros(1 << (_LENGTH - _MESSAGE), dtype=np.int64)
        self.error[remainders] = errors
        self.error[0] = 0

    @staticmethod
    def _remainder(word: int) -> int:
        for bit in range(_LENGTH - 1, _LENGTH - _MESSAGE - 1, -1):
            if word >> bit & 1:
                word ^= _GENERATOR << (bit - (_LENGTH - _MESSAGE))
        return word

    def remainder(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros_like(words)
        for i, value in enumerate(self.remainders):
            out ^= np.where(words >> i & 1, value, 0)
        return out

    def keys(self, words: np.ndarray) -> np.ndarray:
        """For each word 24 messages, with repeats: of itself and of its neighbours."""
        flips = np.concatenate(([0], 1 << np.arange(_LENGTH, dtype=np.int64)))
        remainders = self.remainder(words)[:, None] ^ np.concatenate(([0], self.remainders))[None, :]
        near = words[:, None] ^ flips[None, :]
        return (near ^ self.error[remainders]) >> (_LENGTH - _MESSAGE)


def golay_keys(prints: DataFrame) -> DataFrame:
    """``(bucket, node)``: the bucket keys of distinct fingerprints, which are the nodes.

    The 64 bits are cut into segments of 23, 23 and 18. Of at most two differing bits, at least one segment has none, and
    the next segment has at most two. So the key is one segment exactly and one Golay key of the next, in each of the three
    turns: fingerprints at most two bits apart share a key, and a key has 30 bits or more.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                prints = batch.column(0).slice(start, 8192).to_numpy(zero_copy_only=False)
                bits = prints.view(np.uint64)
                parts = [(bits >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in ((0, 23), (23, 23), (46, 18))]
                buckets, nodes = [], []
                for turn in range(3):
                    keys = np.sort(code.keys(parts[(turn + 1) % 3]), axis=1)
                    fresh = np.concatenate((np.ones((len(keys), 1), dtype=bool), keys[:, 1:] != keys[:, :-1]), axis=1)
                    row, column = np.nonzero(fresh)
                    buckets.append((turn << 40) | (parts[turn][row] << _MESSAGE) | keys[row, column])
                    nodes.append(prints[row])
                yield pa.record_batch([np.concatenate(buckets), np.concatenate(nodes)], names=["bucket", "node"])

    return prints.select("fingerprint").mapInArrow(of, "bucket long, node long")


def within(bits: int):
    def near(a: Column, b: Column) -> Column:
        return F.bit_count(a.bitwiseXOR(b)) <= bits

    return near


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``(key, fingerprint, component_id)`` for each row; component_id is the smallest key reachable by links.

    Rows link if their fingerprints differ in at most two bits: the reach of the Golay keys. Equal fingerprints are one
    node, so thousands of copies cost one set of keys. A NULL key takes part and is never a component_id unless all of its
    component are NULL. An empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, key, text, words), "fingerprints")
    distinct = materialise(prints.groupBy("fingerprint").agg(F.min(key).alias("first")), "distinct-fingerprints")
    groups = groups_in_buckets(materialise(golay_keys(distinct), "golay-keys"), within(BITS), label="simhash")
    grouped = distinct.join(groups, distinct["fingerprint"] == groups["node"]).select("fingerprint", "component", "first")
    smallest = grouped.groupBy("component").agg(F.min("first").alias("smallest"))
    named = grouped.join(smallest, "component").select("fingerprint", "smallest")
    every = distinct.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("smallest", "first").alias("component_id"))
    return prints.join(every, "fingerprint").select(key, "fingerprint", "component_id")
