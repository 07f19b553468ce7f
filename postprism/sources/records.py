"""Quoted delimited files read in parts, also where a quoted field goes on over several lines or parts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postprism.session import materialise

_CLOSING = re.compile('(?:[^"]++|"")*+"')  # from inside quotes to the quote that ends the field
_WHOLE, _GOES_ON, _BEGINS = 0, 1, 2  # a record within one part; the rest of an earlier part's record; one that the part does not end


def inside_after(line: str, inside: bool) -> bool:
    """Whether the end of a line lies inside quotes, given whether its start does.

    A quote opens a field only at the field's start; elsewhere in an unquoted field it is an ordinary character.
    """
    if inside:
        at = 0
    elif line.startswith('"'):
        at = 1
    else:
        at = line.find(',"') + 2
        if at < 2:
            return False
    while True:
        closed = _CLOSING.match(line, at)
        if closed is None:
            return True
        at = line.find(',"', closed.end()) + 2
        if at < 2:
            return False


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """(first row, end, (file, start)) of the batch's stretches that come from one part of one file."""
    files, starts = batch.column(1).to_numpy(), batch.column(2).to_numpy()
    if not len(files):
        return
    begins = np.append(0, np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1)
    for low, high in zip(begins, np.append(begins[1:], len(files)), strict=True):
        yield int(low), int(high), (int(files[low]), int(starts[low]))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part whether its end lies inside quotes, if its start lies outside and if it lies inside."""
    ends: dict[tuple[int, int], tuple[bool, bool]] = {}
    for batch in batches:
        quoted = np.flatnonzero(pc.match_substring(batch.column(0), '"').to_numpy(zero_copy_only=False))
        for low, high, part in _runs(batch):
            outside, inside = ends.get(part, (False, True))
            for row in quoted[np.searchsorted(quoted, low) : np.searchsorted(quoted, high)]:
                line = batch.column(0)[row].as_py()
                outside, inside = inside_after(line, outside), inside_after(line, inside)
            ends[part] = outside, inside
    columns = [[part[0] for part in ends], [part[1] for part in ends], [end[0] for end in ends.values()], [end[1] for end in ends.values()]]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
    yield pa.record_batch([pa.array(values, type=kind) for values, kind in zip(columns, kinds, strict=True)], names=["_file", "_start", "_outside", "_inside"])


def _records(whole: bool):
    """Records that lie in one part (``whole``), or what a part holds of records that do not."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[str, int, int, int, bool]] = []
        part, inside, first = None, False, False
        held: list[str] = []
        kind = _WHOLE

        def take(text: str, kind: int) -> None:
            nonlocal first
            if kind == _WHOLE and text in ("", "\r"):  # an empty line is no record
                return
            if (kind == _WHOLE) == whole:
                found.append((text, *part, kind, first))
            first = False

        def close() -> None:
            if held:
                take("\n".join(held), _GOES_ON if kind == _GOES_ON else _BEGINS)
                held.clear()

        for batch in batches:
            lines = batch.column(0)
            quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
            for low, high, here in _runs(batch):
                if here != part:
                    close()
                    part, inside, first = here, batch.column(3)[low].as_py(), here[1] == 0
                    if inside is None:
                        raise RuntimeError("the files are cut into other parts than when their quotes were looked at: read them again")
                    kind = _GOES_ON if inside else _WHOLE
                for row, line in enumerate(lines.slice(low, high - low).to_pylist(), start=low):
                    if not inside and not quoted[row]:
                        take(line, _WHOLE)
                        continue
                    held.append(line)
                    inside = inside_after(line, inside) if quoted[row] else inside
                    if not inside:
                        take("\n".join(held), kind)
                        held.clear()
                        kind = _WHOLE
            yield _batch(found)
            found.clear()
        close()
        yield _batch(found)

    return of


def _batch(found: list[tuple[str, int, int, int, bool]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
    return pa.record_batch(
        [pa.array(values, type=kind) for values, kind in zip(columns, kinds, strict=True)], names=["record", "_file", "_start", "_part", "header"]
    )


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record, header)``: the records of delimited files as text, read in as many tasks as the files have parts.

    Lines end with a line feed; if the first one ends with a carriage return too, all do, and in quotes such an end becomes a line feed.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")
    )
    records = records_of(lines)
    first = spark.read.option("lineSep", "\n").text(path).first()
    if first is None or not first["value"].endswith("\r"):
        return records
    return records.select(F.replace(F.regexp_replace("record", "\r$", ""), F.lit("\r\n"), F.lit("\n")).alias("record"), "header")


def records_of(lines: DataFrame) -> DataFrame:
    """``(record, header)`` of ``lines (value, _file, _start)``, each part ``(_file, _start)`` of a file in one task and in order.

    A part does not know whether it starts inside a quoted field. So one pass finds for each part where it would end from either
    start, one small row each; a running composition of these over a file's parts gives every part's start. The second pass reads the
    lines again and emits the records that lie within a part. Only where some part does start inside quotes are the pieces at the
    parts' edges read too and joined to records. ``header`` marks each file's first record. Empty lines are no records.
    """
    starts = materialise(_starts(lines.mapInArrow(_ends, "_file long, _start long, _outside boolean, _inside boolean")), "csv-parts")
    # One row of 17 bytes a part: 100 TB in parts of 128 MB are 800,000 rows.
    known = lines.join(F.broadcast(starts), ["_file", "_start"], "left").select("value", "_file", "_start", "_inside")
    kinds = "record string, _file long, _start long, _part int, header boolean"
    records = known.mapInArrow(_records(whole=True), kinds).select("record", "header")
    if not starts.where("_inside").isEmpty():
        records = records.union(_joined(known.mapInArrow(_records(whole=False), kinds)))
    return records


def _starts(ends: DataFrame) -> DataFrame:
    """``(_file, _start, _inside)``: whether each part starts inside quotes.

    Read from outside and from inside, a part either ends the same way, which settles the next start, or keeps the difference or turns it
    round. So a start is the last settled end, turned as often as the parts since then do.
    """
    file = Window.partitionBy("_file").orderBy("_start")
    upto, before = file.rowsBetween(Window.unboundedPreceding, 0), file.rowsBetween(Window.unboundedPreceding, -1)
    turns = ends.withColumn("_turn", (F.col("_outside") & ~F.col("_inside")).cast("int"))
    turned = turns.withColumn("_turned", F.sum("_turn").over(upto))
    settled = F.when(F.col("_outside") == F.col("_inside"), F.struct(F.col("_outside").cast("int").alias("end"), "_turned"))
    last = turned.withColumn("_last", F.last(settled, ignorenulls=True).over(before))
    turns_since = F.col("_turned") - F.col("_turn") - F.coalesce(F.col("_last._turned"), F.lit(0))
    return last.select("_file", "_start", ((F.coalesce(F.col("_last.end"), F.lit(0)) + turns_since) % 2 == 1).alias("_inside"))


def _joined(pieces: DataFrame) -> DataFrame:
    """Records of several parts: what begins in one part with what goes on in the following ones."""
    order = Window.partitionBy("_file").orderBy("_start", "_part").rowsBetween(Window.unboundedPreceding, 0)
    pieces = materialise(pieces, "csv-pieces")
    number = pieces.select("_file", "_start", "_part", F.count_if(F.col("_part") == _BEGINS).over(order).alias("_record"))  # at most two rows a part
    numbered = pieces.join(number, ["_file", "_start", "_part"])
    texts = F.array_sort(F.collect_list(F.struct("_start", "_part", "record")))
    whole = numbered.groupBy("_file", "_record").agg(texts.alias("_texts"), F.max("header").alias("header"))
    return whole.select(F.array_join("_texts.record", "\n").alias("record"), "header")


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files with a header as text columns, read in parts; files whose headers differ are refused when rows are read."""
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    names = spark.read.csv(path, header=True, **options).columns
    written = spark.read.csv(path, header=False, **options).limit(1).collect()
    if not names or not written:
        return spark.read.csv(path, header=True, **options)
    kinds = T.StructType([T.StructField(name, T.StringType()) for name in names])
    ddl = ", ".join("`" + name.replace("`", "``") + "` string" for name in names)
    rows = quoted_records(spark, path).select("header", F.from_csv("record", ddl, options).alias("row"))
    first = spark.createDataFrame([tuple(written[0])], kinds).select(F.struct(*[f"`{name}`" for name in names]).alias("_header"))
    checked = rows.crossJoin(F.broadcast(first)).select(  # one row
        F.when(F.col("header") & ~F.col("row").eqNullSafe(F.col("_header")), F.raise_error(F.lit("the files' headers differ")).cast("boolean"))
        .otherwise(F.col("header"))
        .alias("header"),
        "row",
    )
    return checked.where(~F.col("header")).select("row.*")
