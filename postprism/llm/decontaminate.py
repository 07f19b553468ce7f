"""Benchmark items inside documents: runs that some edits must leave whole, exact edit distance.

An item of n words that is held with e edits at most, cut into e + 1 runs, has one run that no edit touches. So every run
of an item is a key, all runs of these sizes in the documents are looked up, and no held item is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postprism.session import materialise

EDIT_SHARE = 0.2  # most edited words per word of an item
_SHORT = 7  # items of fewer words are looked up whole
_BLOOM_BITS = 25  # the filter of item keys has 2 ** 25 bits: 4 MB, whatever the benchmark
_PART = 1 << 20  # characters of texts taken at a time

# Bytes of ASCII letters and digits and of all longer characters make words; the rest parts them.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True

_ODD, _FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _FIRST
    values = (values ^ (values >> np.uint64(27))) * _SECOND
    return values ^ (values >> np.uint64(31))


def _powers(base: int, size: int) -> np.ndarray:
    factors = np.full(size, base, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2 ** 64, as far as they were needed."""

    def __init__(self) -> None:
        self.size = 0

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > self.size:
            self.size = 1 << (size - 1).bit_length()
            self.up, self.down = (_powers(value, self.size) for value in (int(_ODD), pow(int(_ODD), -1, 1 << 64)))
        return self.up[:size], self.down[:size]


_POWERS = _Powers()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, in order, and where each text's words begin (one more at the end).

    Every text is followed by one word 0, which is no word's hash, so that no window reaches into the next text.
    """
    raw = [text.lower().encode() for text in texts]
    whole = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    inside = _IN_WORD[whole]
    edge = np.diff(np.concatenate(([False], inside)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _POWERS.upto(len(whole) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((whole.astype(np.uint64) + np.uint64(1)) * up[:-1])))
    words = _mix((total[ends] - total[starts]) * down[starts]) | np.uint64(1)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(part) + 1 for part in raw)]))
    begins = bounds + np.arange(len(bounds))
    padded = np.zeros(len(words) + len(texts), dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    padded[np.arange(len(words)) + owner] = words
    return padded, begins


def item_runs(words: int) -> list[tuple[int, int]]:
    """(begin, end) of the runs that an item is cut into: one more than the edits it may have, of nearly one size."""
    runs = int(words * EDIT_SHARE) + 1 if words >= _SHORT else 1
    bounds = [words * i // runs for i in range(runs + 1)]
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def reach_of(words: int) -> int:
    """The power of two of words that an item fits in, so that a few reaches do for all items; short items have their own."""
    return words if words < _SHORT else 1 << (words - 1).bit_length()


def short_keys(words: np.ndarray, size: int) -> np.ndarray:
    """A key of each run of ``size`` words; runs over a text's end get the key 0."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    count = len(words) - size + 1
    key, whole = np.full(count, size, dtype=np.uint64), np.ones(count, dtype=bool)
    for step in range(size):
        key = key * _ODD + words[step : step + count]
        whole &= words[step : step + count] != 0
    return np.where(whole, _mix(key), np.uint64(0))


def run_keys(words: np.ndarray, size: int, reach: int) -> np.ndarray:
    """The keys of runs of ``size`` words for items of one reach; 0 stays 0."""
    keys = short_keys(words, size)
    return np.where(keys != 0, _mix(keys + np.uint64(reach) * _ODD), np.uint64(0))


def _probes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << _BLOOM_BITS) - 1)
    return (keys & mask).astype(np.int64), (keys >> np.uint64(64 - _BLOOM_BITS)).astype(np.int64)


def item_keys(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(item, size, reach, hashed, key, start)``: the keys of every item, their runs' size and the word where they begin.

    Items without words give no row; items repeated under one id take part each.
    """

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for item, text in zip(part["item"], part["text"], strict=True):
                hashed = word_hashes([text or ""])[0][:-1]
                own, reach = hashed.view(np.int64).tolist(), reach_of(len(hashed))
                for begin, end in item_runs(len(hashed)) if own else []:
                    value = run_keys(hashed[begin:end], end - begin, reach)[0]
                    rows.append((item, end - begin, reach, own, int(value.view(np.int64)), begin))
            yield pd.DataFrame(rows, columns=["item", "size", "reach", "hashed", "key", "start"])

    rows = items.select(F.col(key).cast("long").alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(of, "item long, size int, reach int, hashed array<long>, key long, start int")


def _bloom(keys: DataFrame) -> np.ndarray:
    """The filter of the items' keys, as 2 ** 25 bits: the driver gets at most 2 ** 19 numbers, whatever the items."""
    shift = 64 - _BLOOM_BITS
    places = keys.select(
        F.explode(F.array(F.col("key").bitwiseAND((1 << _BLOOM_BITS) - 1), F.shiftrightunsigned("key", shift))).alias("place")
    )
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")
    )
    rows = words.toPandas()
    filled = np.zeros(1 << (_BLOOM_BITS - 6), dtype=np.int64)
    filled[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return filled.view(np.uint64)


def _regions(docs: DataFrame, key: str, text: str, bloom: np.ndarray, kinds: list[tuple[int, int]]) -> DataFrame:
    """``(key, text_hash, region, base, hashed, hits)``: stretches of documents around runs whose key may be an item's."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def maybe(keys: np.ndarray) -> np.ndarray:
        filled = shared.value
        first, second = _probes(keys)
        hit = (filled[first >> 6] >> (first & 63).astype(np.uint64)) & np.uint64(1) != 0
        place = np.flatnonzero(hit)
        second = second[place]
        return place[(filled[second >> 6] >> (second & 63).astype(np.uint64)) & np.uint64(1) != 0]

    def hits(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(reach, keys, places) of the runs found."""
        for size, reach in kinds:
            keys = run_keys(words, size, reach)
            place = maybe(keys)
            place = place[keys[place] != 0]
            if len(place):
                yield reach + int(reach * EDIT_SHARE), keys[place], place

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _parts(batch.column(2)):
                words, begins = word_hashes(texts)
                found = list(hits(words))
                if not found:
                    continue
                places = np.concatenate([place for _, _, place in found])
                keys = np.concatenate([own for _, own, _ in found]).view(np.int64)
                reach = np.concatenate([np.full(len(place), value) for value, _, place in found])
                order = np.argsort(places, kind="stable")
                places, keys, reach = places[order], keys[order], reach[order]
                owner = np.searchsorted(begins, places, side="right") - 1
                # an item found by one of its runs lies within its words and edits before and after
                low = np.maximum(places - reach, begins[owner])
                high = np.minimum(places + reach, begins[owner + 1] - 1)
                cut = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (places[1:] - places[:-1] > reach[:-1]))))
                rows = []
                for a, b in zip(cut, [*cut[1:], len(places)], strict=True):
                    doc, base = int(owner[a]), int(low[a:b].min())
                    rows.append(
                        (
                            batch.column(0)[first + doc].as_py(),
                            batch.column(1)[first + doc].as_py(),
                            int(a),
                            base - int(begins[doc]),
                            words[base : int(high[a:b].max())].view(np.int64),
                            [{"key": k, "at": p} for k, p in zip(keys[a:b].tolist(), (places[a:b] - base).tolist(), strict=True)],
                        )
                    )
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch(
                    [
                        pa.array(columns[0], pa.int64()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.int32()),
                        pa.array(columns[3], pa.int64()),
                        pa.array(columns[4], pa.list_(pa.int64())),
                        pa.array(columns[5], pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())]))),
                    ],
                    names=["id", "text_hash", "region", "base", "hashed", "hits"],
                )

    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    shape = "id long, text_hash long, region int, base long, hashed array<long>, hits array<struct<key: long, at: int>>"
    return rows.mapInArrow(of, shape).withColumn("region", F.concat_ws("-", F.expr("uuid()"), "region"))


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    first, texts, size = 0, [], 0
    for row, value in enumerate(column):
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= _PART:
            yield first, texts
            first, texts, size = row + 1, [], 0
    if texts:
        yield first, texts


def edits_within(region: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Fewest word edits that turn some stretch of the region into the item, and that stretch: (edits, begin, end).

    The exact dynamic programme, one item word at a time: insertions along a row come from a running minimum.
    """
    places = np.arange(len(region) + 1)
    costs, begins = np.zeros(len(region) + 1, dtype=np.int64), places.copy()
    for i, word in enumerate(item, start=1):
        swap = costs[:-1] + (region != word)
        skip = costs[1:] + 1
        best = np.concatenate(([i], np.minimum(swap, skip)))
        origin = np.concatenate(([0], np.where(swap <= skip, begins[:-1], begins[1:])))
        lowest = np.minimum.accumulate((best - places) * (len(places) + 1) + places)  # the latest of the lowest
        source = lowest - (lowest // (len(places) + 1)) * (len(places) + 1)
        costs, begins = best[source] + places - source, origin[source]
    end = int(costs.argmin())
    return int(costs[end]), int(begins[end]), end


def _verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for row in part.itertuples():
            region, item = np.asarray(row.hashed, dtype=np.int64), np.asarray(row.words_of, dtype=np.int64)
            most, best = int(len(item) * EDIT_SHARE), None
            for at in sorted(set(row.places)):
                if 0 <= at <= len(region) - len(item) and np.array_equal(region[at : at + len(item)], item):
                    best = (0, at, at + len(item))
                    break
            # an edit spoils one of the item's words at most, so all others must be there, near a run that was found
            near = (region[max(at - most, 0) : max(at + len(item) + most, 0)] for at in sorted(set(row.places)))
            if best is None and most and any(np.isin(item, part).sum() >= len(item) - most for part in near):
                best = edits_within(region, item)
            if best is not None and best[0] <= most:
                rows.append((row.id, row.text_hash, row.item, best[0], row.base + best[1], row.base + best[2]))
        yield pd.DataFrame(rows, columns=["id", "text_hash", "item", "edits", "first_word", "end_word"]).astype({"id": "Int64", "item": "Int64"})


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(key, text_hash, item, edits, first_word, end_word)``: each item that a document holds, at its best place.

    A document holds an item if some stretch of its words can be turned into the item's words by at most EDIT_SHARE
    word edits per item word; items of fewer than _SHORT words must appear word for word. Words are runs of lower-cased
    letters and digits. All runs of whole texts are looked up in a fixed-size filter of the items' keys; keys that may be an
    item's are joined, and the distance is computed exactly where they agree. NULL or empty texts hold
    nothing, an empty benchmark is held by nothing; a repeated row has the rows of one; a NULL id or item stays NULL.
    """
    known = materialise(item_keys(items, item, item_text), "item-keys")
    kinds = sorted(tuple(row) for row in known.select("size", "reach").distinct().collect())  # a few
    regions = materialise(_regions(docs, key, text, _bloom(known), kinds), "regions")
    hits = regions.select("region", F.explode("hits").alias("hit")).select("region", "hit.key", "hit.at")
    pairs = (
        hits.join(known.select("key", "item", "start", F.xxhash64("hashed").alias("version")), "key")
        .groupBy("region", "item", "version")
        .agg(F.collect_set(F.col("at") - F.col("start")).alias("places"))
    )
    texts = known.select("item", F.xxhash64("hashed").alias("version"), F.col("hashed").alias("words_of")).dropDuplicates(["item", "version"])
    matched = pairs.join(texts.withColumnRenamed("item", "of"), (F.col("item").eqNullSafe(F.col("of"))) & (pairs["version"] == texts["version"])).drop("of", "version")
    found = regions.drop("hits").join(matched, "region").select("id", "text_hash", "base", "hashed", "item", "places", "words_of")
    shape = "id long, text_hash long, item long, edits int, first_word long, end_word long"
    best = found.mapInPandas(_verify, shape).groupBy("id", "text_hash", "item").agg(F.min(F.struct("edits", "first_word", "end_word")).alias("best"))
    return best.select(F.col("id").alias(key), "text_hash", F.col("item").alias(item), "best.edits", "best.first_word", "best.end_word")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item. Rows are told apart by id and text, so a NULL id is no reason to go."""
    held = leaks(docs.select(key, text), items, key, text).select(F.col(key).alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(held, docs[key].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text]) == F.col("_hash")), "left_anti")
