"""Byte-pair encoding of whole texts through a trie of their distinct words, and decoding."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postprism.llm.words import parts, split_words, trimmed

# Fixed value: how the vocabulary's file cuts normalised text into pieces (pieces hold no white space here).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
_END = "</w>"
_CACHED = 500_000  # words and pieces a worker remembers
_INSERTED = 20_000  # pieces per trie
_PART = 2 << 20  # characters encoded together


class Vocabulary:
    """Tokens and merges of a vocabulary file with word ends, and whether two tokens may stand side by side."""

    def __init__(self, content: str) -> None:
        data = json.loads(content)
        model = data["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _END:
            raise ValueError("a byte-level BPE vocabulary with word ends is needed")
        self.strings = {number: token for token, number in model["vocab"].items()}
        self.special = {token["content"]: token["id"] for token in data["added_tokens"]}
        self.strings.update({number: token for token, number in self.special.items()})
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        byte = {char: value for value, char in enumerate(_byte_characters())}
        self.bytes: dict[int, bytes] = {}
        self.ends: dict[int, bool] = {}
        self.inner: dict[bytes, int] = {}  # tokens inside a word
        self.final: dict[bytes, int] = {}  # tokens that end one
        for token, number in model["vocab"].items():
            final = token.endswith(_END) and len(token) > len(_END)
            body = token.removesuffix(_END) if final else token
            if all(char in byte for char in body):
                self.bytes[number] = bytes(byte[char] for char in body)
                self.ends[number] = final
                (self.final if final else self.inner)[self.bytes[number]] = number
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            merged = model["vocab"][left + right]
            self.merges[model["vocab"][left], model["vocab"][right]] = (rank, merged)
        self.lengths = {number: len(body) for number, body in self.bytes.items()}
        self.meets: dict[int, bool] = {}
        self._index_suffixes()

    def _index_suffixes(self) -> None:
        """The tokens' texts as an automaton: each state is a text some token begins with, and lists the tokens it ends
        with, longest first; ``fallback`` is the longest shorter end of it that is a state too."""
        self.following: list[dict[int, int]] = [{}]
        self.inner_ends: list[tuple[tuple[int, int], ...]] = [()]
        self.final_ends: list[tuple[tuple[int, int], ...]] = [()]
        for number, body in self.bytes.items():
            state = 0
            for value in body:
                if (after := self.following[state].get(value)) is None:
                    after = self.following[state][value] = len(self.following)
                    self.following.append({})
                    self.inner_ends.append(())
                    self.final_ends.append(())
                state = after
            ends = self.final_ends if self.ends[number] else self.inner_ends
            ends[state] = ((number, len(body)),)
        self.fallback = [0] * len(self.following)
        waiting = [0]
        for state in waiting:  # by length, so a state's fallback is complete before it
            for value, after in self.following[state].items():
                if state:
                    back = self.fallback[after] = self.step(self.fallback[state], value)
                    self.inner_ends[after] += self.inner_ends[back]
                    self.final_ends[after] += self.final_ends[back]
                waiting.append(after)

    def step(self, state: int, value: int) -> int:
        """The state after one more byte."""
        while (after := self.following[state].get(value)) is None:
            if not state:
                return 0
            state = self.fallback[state]
        return after

    def merged(self, body: bytes, final: bool) -> list[int]:
        """The plain definition: merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.inner[body[i : i + 1]] for i in range(len(body))]
        if final:
            ids[-1] = self.final[body[-1:]]
        while len(ids) > 1:
            ranked = [(found[0], i, found[1]) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (found := self.merges.get(pair))]
            if not ranked:
                break
            _, i, token = min(ranked)
            ids[i : i + 2] = [token]
        return ids

    def may_meet(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart: the merges of their joined text give just them. ``left`` -1: nothing before."""
        key = (left + 1) << 20 | right
        if (known := self.meets.get(key)) is None:
            if left < 0:
                known = self.merged(self.bytes[right], self.ends[right]) == [right]
            elif (left, right) in self.merges:
                known = False
            else:
                known = self.merged(self.bytes[left] + self.bytes[right], self.ends[right]) == [left, right]
            if len(self.meets) >= 1_000_000:
                self.meets.clear()
            self.meets[key] = known
        return known

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Token ids of distinct pieces, by a depth-first walk of the trie of their prefixes.

        Pieces are inserted in sorted order, which is the walk's own order, so only the open path is held: what a piece shares
        with the one before stays, the rest is left for good. Each prefix gets its last token once, whatever number of pieces share it.

        An encoding is the one sequence in which every two neighbours may meet, so of the tokens a prefix may end with exactly one
        fits the last token of what stands before it. A piece's encoding is read backwards from its own last token.
        """
        following, fallback, lengths = self.following, self.fallback, self.lengths
        inner_ends, final_ends, meets = self.inner_ends, self.final_ends, self.meets
        encoded: dict[bytes, tuple[int, ...]] = {}
        last, states, before = [-1], [0], b""  # of the prefixes on the path, from the empty one
        for piece in sorted(pieces):
            size = len(piece)
            most = min(len(last), size) - 1
            shared = 0
            while shared < most and before[shared] == piece[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            before, state = piece, states[shared]
            for at in range(shared, size):
                value = piece[at]
                while (after := following[state].get(value)) is None and state:
                    state = fallback[state]
                state = after or 0
                ends = inner_ends if at + 1 < size else final_ends
                for token, length in ends[state]:
                    left = last[at + 1 - length]
                    if meets.get((left + 1) << 20 | token) or self.may_meet(left, token):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                if at + 1 < size:  # a whole piece is no prefix yet
                    last.append(token)
                    states.append(state)
            tokens, rest = [token], size - lengths[token]
            while rest:
                token = last[rest]
                tokens.append(token)
                rest -= lengths[token]
            encoded[piece] = tuple(reversed(tokens))
        return encoded


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(value) if value in own else chr(next(others)) for value in range(256)]


class Encoder:
    """Encodes texts; remembers the words met so far, up to a bound: their number, ids and decoded form."""

    def __init__(self, content: str) -> None:
        self.vocabulary = Vocabulary(content)
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.known: dict[str | int, int] = {}  # the number of a word or, as a number, of a special token
        self.ids = np.zeros(0, dtype=np.int32)  # of all known words, in the order of their numbers
        self.ends = np.zeros(1, dtype=np.int64)
        self.decoded: list[str] = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return self.encode_and_decode(texts)[0]

    def encode_and_decode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids of each text, and what these decode to: token strings joined by spaces, so words are put together decoded."""
        cut = [self._cut(text) for text in texts]
        self._learn(chain.from_iterable(cut))
        numbers = list(map(self.known.__getitem__, chain.from_iterable(cut)))
        bounds = np.concatenate(([0], np.cumsum([len(words) for words in cut]))).tolist()
        chosen = np.array(numbers, dtype=np.int64)
        starts, lengths = self.ends[chosen], self.ends[chosen + 1] - self.ends[chosen]
        before = np.concatenate(([0], np.cumsum(lengths)))
        places = np.arange(before[-1]) + np.repeat(starts - before[:-1], lengths)
        ids = np.split(self.ids[places], before[bounds[1:-1]])
        form = self.decoded.__getitem__
        return ids, [" ".join(map(form, numbers[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _learn(self, words: Iterable[str | int]) -> None:
        held = len(self.known)
        new = trimmed(self.known, words, _CACHED)
        if len(self.known) < held:
            self.ids, self.ends, self.decoded = self.ids[:0], self.ends[:1], []
        found = {word: _pieces(word) for word in new if isinstance(word, str)}
        pieces = trimmed(self.pieces, chain.from_iterable(found.values()), _CACHED)
        for i in range(0, len(pieces), _INSERTED):
            self.pieces |= self.vocabulary.encode_pieces(pieces[i : i + _INSERTED])
        own = self.pieces
        ids = [
            (word,) if isinstance(word, int) else own[cut[0]] if len(cut := found[word]) == 1 else [i for one in cut for i in own[one]]
            for word in new
        ]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum([len(one) for one in ids], dtype=np.int64)))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(ids), dtype=np.int32)))
        string = self.vocabulary.strings.__getitem__
        self.decoded += [" ".join(map(string, one)) for one in ids]

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by a space: the vocabulary's file names no decoder."""
        return " ".join(map(self.vocabulary.strings.__getitem__, ids.tolist()))

    def _cut(self, text: str) -> list[str | int]:
        """Words and, as numbers, the special tokens written in the text."""
        special = self.vocabulary.special
        if not any(token in text for token in special):
            return split_words(text)
        out, at = [], 0
        for match in self.vocabulary.special_pattern.finditer(text):
            out += split_words(text[at : match.start()])
            out.append(special[match[0]])
            at = match.end()
        return out + split_words(text[at:])


def _pieces(word: str) -> list[bytes]:
    if word.isascii() and word.isalpha():
        return [word.lower().encode()]
    return [piece.encode() for piece in _PIECES.findall(_normal(word))]


def _normal(word: str) -> str:
    """Composed and lower-cased character by character: a final sigma is not told apart."""
    if word.isascii():
        return word.lower()
    return unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()


@lru_cache(maxsize=2)
def _encoder(content: str) -> Encoder:
    return Encoder(content)


def encode_and_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids, decoded)`` for each row: token ids of the whole text and the text they decode to.

    ``vocabulary`` is the path of a byte-level BPE file with word ends, read by the driver; its fixed content goes to
    the executors. NULL and empty texts have no ids and decode to an empty text; repeated rows give a row each; other
    columns are left out. Texts are taken some megabytes at a time and only their distinct new words are encoded.
    """
    content = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        for batch in batches:
            for first, texts in parts(batch.column(1), _PART):
                ids, decoded = encoder.encode_and_decode(texts)
                offsets = np.concatenate(([0], np.cumsum([len(own) for own in ids]))).astype(np.int32)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))),
                        pa.array(decoded, type=pa.string()),
                    ],
                    names=["key", "ids", "decoded"],
                )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(of, "key long, ids array<int>, decoded string").select(F.col("key").alias(key), "ids", "decoded")


def digests(encoded: DataFrame, *kept: str) -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` of what ``encode_and_decode`` returns, after its columns ``kept``."""
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        *kept,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
