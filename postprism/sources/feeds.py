"""Landed feed payloads, one JSON document per file, as records of nine fields.

Fetching is left to whatever lands the files; a payload is one page of an API's answer.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postprism.functions.text import clean_text, joined, strip_markup
from postprism.schemas import FEED_RECORD

# Up to this many files per feed their numbers are sent to every executor (some 200 bytes per name).
BROADCAST_FILES = 100_000

# Order of arrival in one number: feed, file within the feed, item within the file.
_FEED_BITS, _FILE_BITS, _ITEM_BITS = 7, 28, 28


@dataclass(frozen=True)
class Feed:
    """Shape of a feed's payload and where each of the nine fields comes from."""

    payload: str
    items: str
    fields: Mapping[str, Column]
    skip_first: bool = False


def _clean(name: str) -> Column:
    return clean_text(F.col(f"item.{name}"))


def feed_shapes() -> dict[str, Feed]:
    """The four payload shapes, in the order in which feeds are read."""
    remote = F.lit(True)
    # Field names of the payloads.
    return {
        "arbeitnow": Feed(
            payload="data array<struct<title:string,company_name:string,location:string,remote:boolean,"
            "job_types:array<string>,created_at:string,description:string,url:string>>",
            items="payload.data",
            fields={
                "title": _clean("title"),
                "company": _clean("company_name"),
                "location": _clean("location"),
                "remote": F.coalesce(F.col("item.remote"), F.lit(False)),
                "schedule": joined(F.col("item.job_types")),
                "posted": F.col("item.created_at"),
                "text": strip_markup(F.col("item.description")),
                "url": _clean("url"),
            },
        ),
        "jobicy": Feed(
            payload="jobs array<struct<jobTitle:string,companyName:string,jobGeo:string,jobType:array<string>,"
            "pubDate:string,jobDescription:string,url:string>>",
            items="payload.jobs",
            fields={
                "title": _clean("jobTitle"),
                "company": _clean("companyName"),
                "location": _clean("jobGeo"),
                "remote": remote,
                "schedule": joined(F.col("item.jobType")),
                "posted": F.col("item.pubDate"),
                "text": strip_markup(F.col("item.jobDescription")),
                "url": _clean("url"),
            },
        ),
        "remoteok": Feed(
            payload="array<struct<position:string,company:string,location:string,date:string,description:string,"
            "url:string>>",
            items="payload",
            fields={
                "title": _clean("position"),
                "company": _clean("company"),
                "location": _clean("location"),
                "remote": remote,
                "schedule": F.lit(None).cast("string"),
                "posted": F.col("item.date"),
                "text": strip_markup(F.col("item.description")),
                "url": _clean("url"),
            },
            skip_first=True,
        ),
        "himalayas": Feed(
            payload="jobs array<struct<title:string,companyName:string,locationRestrictions:array<string>,"
            "employmentType:string,pubDate:string,description:string,applicationLink:string>>",
            items="payload.jobs",
            fields={
                "title": _clean("title"),
                "company": _clean("companyName"),
                "location": joined(F.col("item.locationRestrictions")),
                "remote": remote,
                "schedule": _clean("employmentType"),
                "posted": F.col("item.pubDate"),
                "text": strip_markup(F.col("item.description")),
                "url": _clean("applicationLink"),
            },
        ),
    }


def arrival_number(feed_rank: int, file_no: Column, item_no: Column) -> Column:
    """Order of arrival as one bigint: rank of the feed, number of the file, position in the file."""
    if feed_rank >= 1 << _FEED_BITS:
        raise ValueError(f"at most {1 << _FEED_BITS} feeds")
    high = F.lit(feed_rank << (_FILE_BITS + _ITEM_BITS)).cast("bigint")
    number = high + F.shiftleft(file_no.cast("bigint"), _ITEM_BITS) + item_no.cast("bigint")
    fits = (file_no < F.lit(1 << _FILE_BITS)) & (item_no < F.lit(1 << _ITEM_BITS))
    return F.when(fits, number).otherwise(F.raise_error(F.lit("too many files of a feed, or items of a file")).cast("bigint"))


def _payloads(files: DataFrame, feed: Feed) -> DataFrame:
    return files.select("_metadata.file_path", F.from_json("value", feed.payload).alias("payload"))


def _items(files: DataFrame, feed: Feed) -> DataFrame:
    """One row per listed item of payload texts: file_path, item_no, item. A text that is no such JSON has none."""
    items = _payloads(files, feed).select("file_path", F.posexplode(feed.items).alias("item_no", "item"))
    return items.where(F.col("item_no") > 0) if feed.skip_first else items


def _nine_fields(source: str, feed: Feed) -> list[Column]:
    return [
        F.lit(source).alias(field.name) if field.name == "source" else feed.fields[field.name].alias(field.name)
        for field in FEED_RECORD
    ]


def read_feed(spark: SparkSession, path: str, source: str, feed: Feed, feed_rank: int) -> DataFrame:
    """Records of one feed in the nine fields, with their ``arrival``.

    Files are taken in path order, items in list order; list items are numbered by ``posexplode`` because row
    order in Spark is not stable.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    names = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("_metadata.file_path")
    )
    # A window over the names only, which the driver holds anyway as the file listing; contents are not read.
    numbers = names.select("file_path", F.row_number().over(Window.orderBy("file_path")).alias("file_no"))
    if len(files.inputFiles()) <= BROADCAST_FILES:
        numbers = F.broadcast(numbers)
    return (
        _items(files, feed)
        .join(numbers, "file_path")
        .select(
            arrival_number(feed_rank, F.col("file_no"), F.col("item_no")).alias("arrival"), *_nine_fields(source, feed)
        )
    )


def stream_feed(spark: SparkSession, path: str, source: str, files_per_batch: int | None = None) -> DataFrame:
    """A feed's folder as a stream of records in the nine fields, with file_path and item_no."""
    feed = feed_shapes()[source]
    reader = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _items(reader.text(path), feed).select("file_path", "item_no", *_nine_fields(source, feed))


def read_feeds(spark: SparkSession, paths: Mapping[str, str]) -> tuple[DataFrame | None, dict[str, str]]:
    """All landed feeds below each other, and what is wrong with each one that is not read whole.

    ``paths`` maps a feed's name to its folder. A feed whose folder is missing or unreadable is skipped, the
    others are read. Of a feed with undecodable payloads the other payloads are read, and their number is reported; that takes
    a pass over the payloads. No feed at all gives None.
    """
    shapes = feed_shapes()
    records, skipped = [], {}
    for rank, (source, feed) in enumerate(shapes.items()):
        if source not in paths:
            continue
        try:
            records.append(read_feed(spark, paths[source], source, feed, rank))
        except AnalysisException as problem:
            skipped[source] = problem.getCondition() or str(problem)
    readable = {source: path for source, path in paths.items() if source in shapes and source not in skipped}
    if readable:
        for row in feed_audit(spark, readable).where("unreadable > 0").collect():  # one row per feed
            skipped[row["source"]] = f"{row['unreadable']} of {row['files']} payloads unreadable"
    return (reduce(DataFrame.unionByName, records) if records else None), skipped


def feed_audit(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """What was landed, one row per feed: source, files, unreadable (without the expected list), records, problem.

    A feed that cannot be read at all is listed with its problem and no files.
    """
    rows = []
    for source, feed in feed_shapes().items():
        if source not in paths:
            continue
        try:
            files = spark.read.text(paths[source], wholetext=True, recursiveFileLookup=True)
        except AnalysisException as problem:
            counted = spark.range(1).select(F.lit(0).alias("files"), F.lit(0).alias("unreadable"), F.lit(0).alias("records"))
            condition = problem.getCondition() or str(problem)
        else:
            items = F.size(F.col(feed.items)) - int(feed.skip_first)
            counted = _payloads(files, feed).agg(
                F.count(F.lit(1)).alias("files"),
                F.count_if(F.col(feed.items).isNull()).alias("unreadable"),
                F.coalesce(F.sum(F.when(F.col(feed.items).isNotNull(), F.greatest(items, F.lit(0)))), F.lit(0)).alias("records"),
            )
            condition = None
        rows.append(
            counted.select(
                F.lit(source).alias("source"),
                *[F.col(name).cast("bigint").alias(name) for name in counted.columns],
                F.lit(condition).cast("string").alias("problem"),
            )
        )
    return reduce(DataFrame.unionByName, rows)
