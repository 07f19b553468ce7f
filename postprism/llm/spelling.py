"""Spelling variants: words one edit apart, found by bit-sliced position indexes, and the frequent word each may stand for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postprism.operators.lookup import fits_broadcast
from postprism.session import materialise

SHORTEST = 7  # fewest code points of a word
OCCURRENCES = 2  # fewest of a word
TYPO_ONE_IN = 31  # a run whose checksum this divides loses one code point
RATIO = 10  # a form is at least so many times as frequent as its variant
BUCKET_WORDS = 2_048  # a bucket with more words is cut again
_ROWS, _CHARS = 1 << 16, 8 << 20  # rows and characters that a task indexes at a time, besides one bucket
_PAIRS = 1 << 20  # pairs of a query and a block of 64 words at a time

_RUN = f"[A-Za-zÀ-ÿ]{{{SHORTEST},}}"  # of a shorter run nothing is left that counts
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: the distinct results of the runs of letters of all texts that occur often enough.

    Only A-Z are lower-cased. A run whose crc32 of ``<key>:<run>`` TYPO_ONE_IN divides loses the code point at that number modulo
    its length. A NULL key counts as the empty text, a NULL text as none. Repeated rows count each time.
    """
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.explode(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))).alias("_run")
    ).select("_key", F.translate("_run", _UPPER, _LOWER).alias("_run"))
    mark = F.crc32(F.concat("_key", F.lit(":"), "_run").cast("binary"))
    rows = runs.select("_run", mark.alias("_mark"))
    at = (F.col("_mark") % F.length("_run")).cast("int")
    shorter = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    found = rows.select(F.when(F.col("_mark") % TYPO_ONE_IN == 0, shorter).otherwise(F.col("_run")).alias("word"))
    counted = found.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= OCCURRENCES)


def _members(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """``rows (word, n, c)`` as members of the buckets whose words may differ only from ``low`` to ``high`` of the c places.

    A bucket holds words of c and of c + 1 characters that are equal before and after that stretch.
    """
    size = F.length("word")
    after = F.col("c") - high
    parts = [F.col("c"), low, high, F.substring(F.col("word"), F.lit(1), low), F.substring(F.col("word"), size - after + 1, after)]
    return rows.select(
        F.concat_ws(" ", *[part.cast("string") for part in parts]).alias("bucket"), "word", "n", "c", low.alias("low"), high.alias("high")
    )


def _halves(rows: DataFrame) -> DataFrame:
    """Members of the two halves of each row's stretch ``low`` to ``high``. One edit leaves one of them untouched."""
    middle = F.expr("low + (high - low) div 2").cast("int")
    stretches = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
    both = rows.select("word", "n", "c", F.explode(stretches).alias("_part"))
    return _members(both, F.col("_part.low"), F.col("_part.high"))


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """``(word, n_near, top_n, top)`` for each word of ``vocabulary (word, n)`` that has near words: their number and the most frequent.

    Near words differ by one inserted, deleted or replaced code point; of equally frequent ones the smallest counts. Words are
    distinct, without NULLs. A pair is compared among words of the shorter one's length c and of c + 1. These are cut into buckets that
    share one half of the places; a bucket with more than BUCKET_WORDS words is cut again, until few are left or one
    place. Each pair is found in one bucket only: the one whose stretch holds the end of the pair's common prefix. So no bucket is large, no
    pair is lost, and pairs are counted where they are found instead of being listed.
    """
    size = F.length("word")
    classes = vocabulary.select("word", "n", F.explode(F.array(size, size - 1)).alias("c")).where(F.col("c") >= SHORTEST)
    open_ = materialise(_halves(classes.withColumn("low", F.lit(0)).withColumn("high", F.col("c"))), "spelling-members")
    found = []
    while True:
        sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size"), F.first("high").alias("_high"), F.first("low").alias("_low"))
        large = materialise(sizes.where((F.col("_size") > BUCKET_WORDS) & (F.col("_high") - F.col("_low") > 1)).select("bucket"), "spelling-large")
        if large.isEmpty():
            found.append(_found(open_))
            break
        few = F.broadcast(large) if fits_broadcast(large) else large
        found.append(_found(open_.join(few, "bucket", "left_anti")))
        open_ = materialise(_halves(open_.join(few, "bucket", "left_semi")), "spelling-members")
    near = materialise(_union(found), "spelling-near")
    best = F.min(F.struct((-F.col("top_n")).alias("less"), F.col("top").alias("word")))
    counted = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return counted.select("word", "n_near", (-F.col("best.less")).alias("top_n"), F.col("best.word").alias("top"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def _found(members: DataFrame) -> DataFrame:
    """``(word, n_near, top_n, top)`` of the words of each bucket that have near words in it."""
    after = F.col("c") - F.col("high")
    rows = members.select(
        "bucket",
        F.expr("substring(word, low + 1, length(word) - low - (c - high))").alias("middle"),
        (F.length("word") > F.col("c")).alias("longer"),
        (after == 0).alias("ends"),
        (F.col("high") - F.col("low")).cast("int").alias("places"),
        "n",
        "word",
    )
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("n").desc(), "word")
    return dealt.mapInArrow(_search, "word string, n_near long, top_n long, top string")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets of the sorted rows, some at a time."""
    held: list[pa.RecordBatch] = []
    rows = chars = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        chars += pc.sum(pc.binary_length(batch.column(1))).as_py()
        if rows < _ROWS and chars < _CHARS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = pc.equal(table["bucket"], table["bucket"][-1])
        whole = pc.index(last, True).as_py()  # the last bucket may go on
        held, rest = [], table.slice(whole)
        rows = chars = 0
        if whole:
            yield from _near_words(table.slice(0, whole))
            rows, chars = rest.num_rows, pc.sum(pc.binary_length(rest["middle"])).as_py()
        held = rest.to_batches()
    if held:
        yield from _near_words(pa.Table.from_batches(held))


def _near_words(table: pa.Table) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    names = table["bucket"].combine_chunks()
    fresh = np.ones(len(names), dtype=bool)
    fresh[1:] = pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.append(first, len(names)))
    places = table["places"].to_numpy()
    shared = np.repeat(sizes, sizes) > 1  # a word alone has no near one
    for length in np.unique(places[shared]):
        own = np.flatnonzero(shared & (places == length))
        part = table.take(own)
        bucket = np.cumsum(fresh[own]) - 1
        counts, tops = _one_edit(
            [value.encode("latin-1") for value in part["middle"].to_pylist()],
            int(length),
            bucket,
            part["longer"].to_numpy(),
            part["ends"].to_numpy(),
        )
        some = np.flatnonzero(counts)
        if len(some):
            top = part.take(tops[some])
            columns = [part["word"].take(some), pa.array(counts[some]), top["n"], top["word"]]
            yield from pa.table(columns, names=["word", "n_near", "top_n", "top"]).to_batches()


def _one_edit(middles: list[bytes], places: int, bucket: np.ndarray, longer: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its near words in its bucket, and the row of the first of them.

    ``middles`` are the stretches in which the words of a bucket may differ, of ``places`` bytes, one more where ``longer``. Rows of a
    bucket are neighbours. Its words are cut into blocks of 64, one bit each. ``index[i]`` holds for each block and letter
    the words with that letter at place i. A query reads its letters once; ``same`` are the words equal so far, ``other`` those with one
    letter replaced, ``more`` those with one letter more and ``less`` those with one letter less than the query, whose places are shifted by one.
    """
    rows = len(middles)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(starts, rows))
    n_blocks = (sizes + 63) // 64
    first_block = np.cumsum(n_blocks) - n_blocks
    place = np.arange(rows) - np.repeat(starts, sizes)
    block = np.repeat(first_block, sizes) + place // 64
    bit = np.uint64(1) << (place % 64).astype(np.uint64)
    total = int(n_blocks.sum())

    padded = b"".join(middle.ljust(places + 1, b"\0") for middle in middles)
    letters = np.frombuffer(padded, dtype=np.uint8).reshape(rows, places + 1)
    known = np.zeros(256, dtype=np.int64)
    used = np.unique(letters)
    known[used] = np.arange(len(used))  # 0 where a word has ended, as this byte is the smallest
    if used[0] != 0:
        known += 1
    width = int(known.max()) + 1
    index = []
    for i in range(places + 1):
        masks = np.zeros(total * width, dtype=np.uint64)
        np.add.at(masks, block * width + known[letters[:, i]], bit)  # each bit once: a sum is a union
        index.append(masks)
    of_size = [np.zeros(total, dtype=np.uint64) for _ in range(2)]
    for flag, masks in zip((False, True), of_size, strict=True):
        np.add.at(masks, block[longer == flag], bit[longer == flag])
    short, long = of_size

    counts, tops = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    faced = np.repeat(n_blocks, sizes)  # blocks that a row is compared with
    bounds = np.searchsorted(np.cumsum(faced), np.arange(0, int(faced.sum()) + _PAIRS, _PAIRS), side="left")
    bounds[0] = 0
    bounds[-1] = rows
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        if low == high:
            continue
        per = faced[low:high]
        query = np.repeat(np.arange(low, high), per)
        step = np.arange(len(query)) - np.repeat(np.cumsum(per) - per, per)
        at = np.repeat(first_block, sizes)[query] + step
        base = at * width
        same = short[at] | long[at]
        other, more, less = (np.zeros(len(query), dtype=np.uint64) for _ in range(3))
        for i in range(places):
            place_of = base + known[letters[query, i]]
            here = index[i][place_of]
            more = (more | same) & index[i + 1][place_of]
            less = (less & index[i - 1][place_of] if i else less) | same
            other = (other & here) | (same & ~here)
            same = same & here
        extra = less & index[places - 1][base + known[letters[query, places]]] if places else less
        asks_longer, is_end = longer[query], ends[query]
        found = np.where(asks_longer, (extra | same) & short[at], (other & short[at]) | ((more | same) & long[at]))
        found = np.where(is_end, found, found & ~same)  # a longer common prefix: found in another bucket
        some = np.flatnonzero(found)
        if not len(some):
            continue
        counts += np.bincount(query[some], weights=np.bitwise_count(found[some]), minlength=rows).astype(np.int64)
        asked, begins = np.unique(query[some], return_index=True)  # blocks are in order, so the first is the most frequent word's
        lowest = found[some][begins]
        lowest = np.bitwise_count((lowest & (~lowest + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        tops[asked] = np.repeat(starts, sizes)[asked] + step[some][begins] * 64 + lowest
    return counts, tops


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each word of the texts (:func:`words`).

    ``form`` is the most frequent near word if it is at least RATIO times as frequent as the word, else NULL; ``root`` is where
    following the forms ends, the word itself without a form. A form is RATIO times as frequent, so chains are short and have no rings.
    No texts or no words: no rows. A very long run is a word like any other.
    """
    vocabulary = materialise(words(docs, key, text), "spelling-words")
    near = neighbours(vocabulary)
    is_form = F.col("top_n") >= F.col("n") * RATIO
    formed = materialise(
        vocabulary.join(near, "word", "left").select(
            "word",
            F.when(is_form, F.col("top")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("top_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialise(roots.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        roots = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
