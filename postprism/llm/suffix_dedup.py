"""Removal of long repeated byte strings: suffix arrays by two-stage sorting over stretches that may repeat.

A string of LENGTH bytes is filed under the smallest hash of its GRAM-byte pieces. Equal strings have equal smallest hashes, so
all copies of a string meet under one value, and values that occur once need no further look. The stretches of text
under the other values are sorted by suffix; neighbours in that order that share LENGTH bytes are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from postprism.session import materialise

LENGTH = 400  # bytes of a string that is removed where it repeats
GRAM = 32  # bytes of a hashed piece
_RUN = 1_024  # most string starts of a stretch
_PIECE = 1 << 20  # bytes hashed together
_BLOCK = 1 << 18  # bytes sorted together, and whole values beyond that
HOT = 512  # stretches of a value, about, that are sorted together; with more they are dealt out by content
_CORE_STEP = 16

_ODD, _FIRST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, size: int) -> np.ndarray:
    factors = np.full(size, base, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_POWERS: list[np.ndarray] = []  # of an odd base and of its inverse, modulo 2 ** 64


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``size`` bytes from each place on; raw holds at most _PIECE + LENGTH bytes."""
    if not _POWERS:
        _POWERS.extend(_powers(value, _PIECE + LENGTH + 1) for value in (int(_ODD), pow(int(_ODD), -1, 1 << 64)))
    up, down = _POWERS
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw + np.uint64(1)) * up[: len(raw)], out=total[1:])
    places = len(raw) - size + 1
    values = (total[size:] - total[:places]) * down[:places]
    values ^= values >> np.uint64(32)
    values *= _FIRST
    values ^= values >> np.uint64(29)
    return values


def smallest(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each ``size`` neighbours, by doubling."""
    span = 1
    while span * 2 <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def stretches(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, value, first, last, twice): maximal runs of string starts under one value, in all texts of together up to
    _PIECE bytes; whether the value's piece may be in the run's bytes twice, so that a string may repeat within the run."""
    lengths = np.array([len(text) for text in texts], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths)))
    if begins[-1] < LENGTH:
        return (np.zeros(0, dtype=np.int64),) * 5
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64)
    grams, span = gram_hashes(raw, GRAM), LENGTH - GRAM + 1
    value = smallest(grams, span)
    starts = np.zeros(len(value) + 1, dtype=np.int8)
    inside = lengths >= LENGTH
    np.add.at(starts, begins[:-1][inside], 1)
    np.add.at(starts, begins[1:][inside] - LENGTH + 1, -1)
    valid = np.flatnonzero(np.cumsum(starts[:-1]))
    owner = np.searchsorted(begins, valid, side="right") - 1
    kept = value[valid]
    fresh = np.concatenate(([True], (kept[1:] != kept[:-1]) | (owner[1:] != owner[:-1])))
    since = np.arange(len(valid)) - np.maximum.accumulate(np.where(fresh, np.arange(len(valid)), 0))
    cut = np.flatnonzero(since % _RUN == 0)
    ends = np.concatenate((cut[1:], [len(valid)])) - 1
    local = valid - begins[owner]

    # pieces that are some string's smallest: no string that holds them has a larger minimum
    edge = np.zeros(span - 1, dtype=np.uint64)
    chosen = np.flatnonzero(grams == ~smallest(~np.concatenate((edge, value, edge)), span))
    again = np.concatenate(([0], np.cumsum((grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) <= span))))
    low, high = np.searchsorted(chosen, valid[cut]), np.searchsorted(chosen, valid[ends] + span - 1, side="right") - 1
    return owner[cut], kept[cut].view(np.int64), local[cut], local[ends], again[high] > again[low]


def _stretch_rows(docs: DataFrame) -> DataFrame:
    """``(text_id, value, first, last, twice)`` of all texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _pieces(batch):
                texts, ids, offsets = zip(*group, strict=True)
                owner, value, first, last, twice = stretches(list(texts))
                ids, offsets = np.array(ids, dtype=np.int64), np.array(offsets, dtype=np.int64)
                if len(owner):
                    yield pa.record_batch(
                        [ids[owner], value, first + offsets[owner], last + offsets[owner], twice],
                        names=["text_id", "value", "first", "last", "twice"],
                    )

    return docs.select("text_id", "text").mapInArrow(of, "text_id long, value long, first long, last long, twice boolean")


def _pieces(batch: pa.RecordBatch) -> Iterator[list[tuple[bytes, int, int]]]:
    """Lists of (bytes, text, offset) of about _PIECE bytes: short texts together, long ones in parts that share LENGTH - 1 bytes."""
    group, size = [], 0
    for row in range(batch.num_rows):
        text, number = batch.column(1)[row].as_py() or b"", batch.column(0)[row].as_py()
        for offset in range(0, max(1, len(text) - LENGTH + 1), _PIECE - LENGTH):
            part = text[offset : offset + _PIECE - 1]
            if len(text) >= LENGTH:
                if size + len(part) > _PIECE:
                    yield group
                    group, size = [], 0
                group.append((part, number, offset))
                size += len(part)
    if group:
        yield group


def suffix_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two-stage suffix sorting of texts, each closed by an end mark smaller than every byte: (suffixes, symbols).

    Suffixes are ordered by their first LENGTH bytes, or to their text's end. Those smaller than their successor are sorted
    directly. The others follow from them: scanning the buckets of first symbols upwards, the predecessor of each
    suffix, if it is larger than that suffix, goes to the next free place at the front of its own bucket.
    """
    symbols = np.concatenate([np.concatenate((np.frombuffer(text, dtype=np.uint8).astype(np.int16) + 1, [0])) for text in texts])
    size = len(symbols)
    step = np.sign(np.diff(symbols, append=np.int16(300)))  # above 0: smaller than the successor; 0: as the successor
    turns = np.flatnonzero(step)
    direct = step[turns[np.searchsorted(turns, np.arange(size))]] > 0

    whole = b"\0".join([*texts, b""])
    ends = np.flatnonzero(symbols == 0)
    places = np.flatnonzero(direct)
    limits = np.minimum(places + LENGTH, ends[np.searchsorted(ends, places)])
    keys = [whole[a:b] for a, b in zip(places.tolist(), limits.tolist(), strict=True)]
    ordered = places[sorted(range(len(places)), key=keys.__getitem__)]
    first = symbols[ordered]  # ascending, so each bucket's share is a slice
    bounds = np.searchsorted(first, np.arange(258))

    front: list[list[np.ndarray]] = [[] for _ in range(257)]

    def hand_on(found: np.ndarray, bucket: int) -> np.ndarray:
        """Put the larger predecessors into their buckets; those of this bucket are returned."""
        before = found[found > 0] - 1
        before = before[~direct[before]]
        if not len(before):
            return before
        symbol = symbols[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        cuts = np.flatnonzero(np.diff(symbol)) + 1
        own = before[:0]
        for part, where in zip(np.split(before, cuts), symbol[np.concatenate(([0], cuts))].tolist(), strict=True):
            front[where].append(part)
            if where == bucket:
                own = part
        return own

    result = []
    for bucket in range(257):
        done = 0
        while done < len(front[bucket]):  # grows while its own suffixes' predecessors join it
            waiting, done = np.concatenate(front[bucket][done:]), len(front[bucket])
            hand_on(waiting, bucket)
        sorted_directly = ordered[bounds[bucket] : bounds[bucket + 1]]
        result += [*front[bucket], sorted_directly]
        hand_on(sorted_directly, bucket)
    return np.concatenate(result), symbols


def common_prefixes(suffixes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, LENGTH at most and never past a text's end.

    Where two neighbours in the order begin with the same byte and the suffixes one byte further are neighbours too, the first two
    share one byte more than those. So only the last of each such chain of places is compared byte by byte.
    """
    before = np.full(len(symbols), -1, dtype=np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    further = (before[:-1] >= 0) & (before[1:] == before[:-1] + 1) & (symbols[:-1] > 0) & (symbols[:-1] == symbols[before[:-1]])
    compared = np.flatnonzero(~np.append(further, False))
    shared = np.zeros(len(symbols), dtype=np.int64)
    paired = compared[before[compared] >= 0]
    shared[paired] = _shared_bytes(before[paired], paired, symbols)
    places = np.arange(len(symbols))
    last = compared[np.searchsorted(compared, places)]
    return np.minimum(shared[last] + last - places, LENGTH)[suffixes]


def _shared_bytes(a: np.ndarray, b: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at ``a`` and ``b`` share, LENGTH at most, eight at a time."""
    ends = np.flatnonzero(symbols == 0)
    most = np.minimum(ends[np.searchsorted(ends, a)] - a, ends[np.searchsorted(ends, b)] - b)
    most = np.minimum(most, LENGTH)
    raw = np.concatenate((symbols, np.zeros(8, dtype=symbols.dtype)))
    raw = np.where(raw > 0, raw - 1, 0).astype(np.uint8)
    words = np.ndarray(len(symbols), dtype="<u8", buffer=raw, strides=(1,))
    found = np.zeros(len(a), dtype=np.int64)
    open_pairs = np.arange(len(a))
    for depth in range(0, LENGTH, 8):
        open_pairs = open_pairs[most[open_pairs] > depth]
        if not len(open_pairs):
            break
        differ = words[a[open_pairs] + depth] ^ words[b[open_pairs] + depth]
        same = np.full(len(differ), 8)
        unequal = differ != 0
        lowest = differ[unequal] & (~differ[unequal] + np.uint64(1))
        same[unequal] = np.bitwise_count(lowest - np.uint64(1)) // 8
        found[open_pairs] += same
        open_pairs = open_pairs[~unequal]
    return np.minimum(found, most)


def repeated_starts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the starts of strings of LENGTH bytes that occur at another start too, in any of the texts; and the
    starts that stand for all strings: one of each."""
    suffixes, symbols = suffix_array(texts)
    ends = np.flatnonzero(symbols == 0)
    long = common_prefixes(suffixes, symbols) >= LENGTH
    repeated, chosen = np.zeros(len(symbols), dtype=bool), np.zeros(len(symbols), dtype=bool)
    repeated[suffixes[long]] = True
    repeated[suffixes[np.flatnonzero(long) - 1]] = True
    whole = ends[np.searchsorted(ends, suffixes)] - suffixes >= LENGTH
    chosen[suffixes[whole & ~long]] = True
    begins = np.concatenate(([0], ends + 1))
    return [(np.flatnonzero(repeated[a:b]), np.flatnonzero(chosen[a:b])) for a, b in zip(begins[:-1], begins[1:], strict=True)]


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of the bytes that neighbouring starts cover."""
    if len(starts):
        cuts = np.flatnonzero(np.diff(starts) > LENGTH)  # strings that touch make one span
        for a, b in zip(np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(starts) - 1])), strict=True):
            yield int(starts[a]), int(starts[b]) + LENGTH


@dataclass
class _Stretch:
    body: bytes
    value: int
    chunk: int
    spread: bool  # whether the value's other chunks hold further stretches
    places: list[tuple[int, int]] = field(default_factory=list)  # (text, start): more than one if copied whole


_SORTED = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("text_id", "begin", "end", "value", "core", "chunk")]
    + [T.StructField("strings", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("open", T.BooleanType())])))]
)


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds from stretches sorted by value, chunk and content, blocks of whole chunks being sorted by suffix.

    Spans: what repeats within a chunk. Strings, of spread values only: one of each kind in the chunk, by core, open if
    it did not repeat there. A chunk of equal stretches alone needs no sorting: all of it repeats.
    """
    rows: list[tuple] = []
    chunk: list[_Stretch] = []
    block: list[_Stretch] = []
    size = 0

    def close_chunk() -> None:
        nonlocal chunk, size
        if len(chunk) == 1 and len(chunk[0].places) > 1 and not chunk[0].spread:
            rows.extend(_whole(chunk[0]))
        else:
            block.extend(chunk)
            size += sum(len(one.body) for one in chunk)
        chunk = []

    def sort() -> pa.RecordBatch:
        nonlocal rows, block, size
        if block:
            for one, (repeated, chosen) in zip(block, repeated_starts([one.body for one in block]), strict=True):
                number, first = one.places[0]
                if len(one.places) > 1:
                    rows.extend(_whole(one))
                else:
                    rows.extend((number, first + a, first + b, None, None, None, None) for a, b in _runs(repeated))
                if one.spread:
                    rows.extend(_strings(one, repeated, chosen))
        columns = list(zip(*rows, strict=True)) or [[] for _ in _SORTED]
        found = pa.record_batch([pa.array(column, kind.type) for column, kind in zip(columns, to_arrow_schema(_SORTED), strict=True)], schema=to_arrow_schema(_SORTED))
        rows, block, size = [], [], 0
        return found

    last = None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["value"], row["chunk"]) != last:
                close_chunk()
                if size >= _BLOCK or len(rows) >= 10_000:
                    yield sort()
            if not chunk or content != row["content"]:
                chunk.append(_Stretch(row["bytes"], row["value"], row["chunk"], row["chunks"] > 1))
            chunk[-1].places.append((row["text_id"], row["first"]))
            last, content = (row["value"], row["chunk"]), row["content"]
    close_chunk()
    if rows or block:
        yield sort()


def _whole(one: _Stretch) -> Iterator[tuple]:
    return ((number, first, first + len(one.body), None, None, None, None) for number, first in one.places)


def _strings(one: _Stretch, repeated: np.ndarray, chosen: np.ndarray) -> Iterator[tuple]:
    """The chosen strings of a stretch by core: the bytes that all strings share whose distance to their value's next
    piece falls into the same _CORE_STEP distances. Equal strings have equal cores."""
    raw = np.frombuffer(one.body, dtype=np.uint8).astype(np.uint64)
    pieces = np.flatnonzero(gram_hashes(raw, GRAM).view(np.int64) == one.value)
    ahead = pieces[np.searchsorted(pieces, chosen)]
    step = (ahead - chosen) // _CORE_STEP
    cores = gram_hashes(raw, LENGTH - _CORE_STEP + 1)[ahead - step * _CORE_STEP] + step.astype(np.uint64) * _ODD
    hashes = gram_hashes(raw, LENGTH)[chosen].view(np.int64)
    is_open = ~np.isin(chosen, repeated) if len(one.places) == 1 else np.zeros(len(chosen), dtype=bool)
    number, first = one.places[0]
    order = np.argsort(cores, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(cores[order])) + 1):
        if len(part):
            strings = [
                {"start": int(first + chosen[i]), "hash": int(hashes[i]), "open": bool(is_open[i])} for i in part
            ]
            yield number, None, None, one.value, int(cores[part[0]].view(np.int64)), one.chunk, strings


def _across_chunks(found: DataFrame) -> DataFrame:
    """Spans of strings that occur in several chunks of a value but repeat in none of them, from the rows of strings.

    Cores that only one chunk has are left out first, so few strings are counted one by one; counts are combined map-side.
    """
    several = [F.min("chunk").alias("low"), F.max("chunk").alias("high")]
    shared = found.groupBy("value", "core").agg(*several).where("low < high").select("value", "core")
    strings = materialise(
        found.join(shared, ["value", "core"], "left_semi").select("value", "chunk", "text_id", F.inline("strings")), "strings"
    )
    common = strings.groupBy("value", "hash").agg(*several).where("low < high").select("value", "hash")
    begin = F.col("start").alias("begin")
    return strings.where("open").join(common, ["value", "hash"], "left_semi").select("text_id", begin, (F.col("start") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, spans)``: each text's bytes and the merged ``(begin, end)`` spans of bytes that a string of LENGTH bytes,
    found at another start too, covers. NULL is an empty text; texts shorter than LENGTH have no spans.

    Equal texts are one text that occurs several times: all of it repeats, and its stretches are looked at once.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")).withColumn(
        "text_id", F.xxhash64("text")
    )
    first = materialise(
        rows.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("of"), F.max(F.octet_length("text")).alias("bytes_long")), "texts"
    )
    found = materialise(_stretch_rows(rows), "stretches")
    place = F.xxhash64("text_id", "first")
    shared = found.groupBy("value").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice")).where("low < high or twice")
    chunks = shared.select("value", F.ceil(F.col("n") / HOT).cast("long").alias("chunks"))
    candidates = found.drop("twice").join(chunks, "value").dropDuplicates(["text_id", "first"])
    per_text = candidates.groupBy("text_id").agg(F.collect_list(F.struct("value", "chunks", "first", "last")).alias("runs"))
    wanted = per_text.join(first.select("text_id", "of"), "text_id").withColumnRenamed("text_id", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, body, runs = (batch.column(i)[row].as_py() for i in range(3))
                if runs:
                    parts = [body[run["first"] : run["last"] + LENGTH] for run in runs]
                    columns = [[run[name] for run in runs] for name in ("value", "chunks", "first", "last")]
                    content = np.array([xxhash.xxh3_64_intdigest(part) for part in parts], dtype=np.uint64).view(np.int64)
                    yield pa.record_batch(
                        [pa.array([number] * len(runs), pa.int64()), *map(pa.array, columns), pa.array(content), pa.array(parts, pa.binary())],
                        names=["text_id", "value", "chunks", "first", "last", "content", "bytes"],
                    )

    bodies = rows.join(wanted, (rows["text_id"] == wanted["id"]) & rows["key"].eqNullSafe(wanted["of"])).select("text_id", "text", "runs")
    shape = "text_id long, value long, chunks long, first long, last long, content long, bytes binary"
    cuts = bodies.mapInArrow(cut, shape).withColumn("chunk", F.pmod("content", "chunks"))
    order = ["value", "chunk", "content"]
    found = materialise(cuts.repartition("value", "chunk").sortWithinPartitions(*order).mapInArrow(_sort_blocks, _SORTED), "sorted")
    spans = found.where("core is null").select("text_id", "begin", "end").union(_across_chunks(found.where("core is not null")))
    copies = first.where((F.col("n") > 1) & (F.col("bytes_long") >= LENGTH)).select("text_id", F.lit(0).cast("long").alias("begin"), F.col("bytes_long").cast("long").alias("end"))
    merged = materialise(
        spans.union(copies).groupBy("text_id").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans")), "spans"
    ).withColumnRenamed("text_id", "id")
    return rows.join(merged, rows["text_id"] == merged["id"], "left").select(F.col("key").alias(key), F.col("text").alias(text), "spans")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, spans, kept)``: the text's length, the maximal removed ``(begin, end)`` runs, and the remaining bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, runs, kept = [], [], []
            for row in range(batch.num_rows):
                body, spans = batch.column(1)[row].as_py(), batch.column(2)[row].as_py() or []
                merged: list[dict[str, int]] = []
                for span in spans:
                    if merged and span["begin"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], span["end"])
                    else:
                        merged.append(span)
                at, rest = 0, []
                for span in merged:
                    rest.append(body[at : span["begin"]])
                    at = span["end"]
                lengths.append(len(body))
                runs.append(merged)
                kept.append(b"".join([*rest, body[at:]]))
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(lengths, pa.int64()),
                    pa.array(runs, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                names=["key", "n_bytes", "spans", "kept"],
            )

    found = repeated_spans(docs, key, text)
    done = found.mapInArrow(of, "key long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")
    return done.withColumnRenamed("key", key)
