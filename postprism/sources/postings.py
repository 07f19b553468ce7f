"""Posting files and star tables on storage."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postprism import schemas
from postprism.operators.prepare import observed
from postprism.sources.records import read_quoted_csv
from postprism.star import Star

_TABLE_SCHEMAS = {
    "company_dim": schemas.COMPANY,
    "skills_dim": schemas.SKILL,
    "job_postings_fact": schemas.FACT,
    "skills_job_dim": schemas.BRIDGE,
}


# Pay as written, wide enough for any amount; the fact's scale is applied when the fact is built.
PAY = T.DecimalType(28, 10)

# Holds the raw text of a row's values that do not fit their type, as JSON; NULL where all fit.
REJECTED = "_rejected"

# A file with line breaks in quotes and more bytes than this is read in parts; smaller ones take one task each, as one pass is cheaper.
WHOLE_FILE_BYTES = 64 << 20


def _largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file, from the file listing: contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def read_postings_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = schemas.WIDE,
    multi_line: bool = True,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> DataFrame:
    """Denormalised postings from delimited files with a header; columns are found by their names.

    Every column of the files is kept, so that rows differing anywhere stay different: those of ``schema`` come first and typed,
    further ones follow as text. A column of the schema that the files lack is NULL. Files whose headers differ are refused.
    A value that does not fit its type becomes NULL and is kept in ``_rejected``; ``load_audit`` counts such rows. Quoted
    fields may hold commas, doubled quotes and, with ``multi_line``, line breaks. Files of more than ``whole_file_bytes`` are read in
    parts with or without line breaks; the rows are the same.
    """
    if multi_line and _largest_file(spark, path) > whole_file_bytes:
        raw = read_quoted_csv(spark, path)
    else:
        raw = spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"', enforceSchema=False)
    known = {field.name for field in schema}
    columns, failed = [], []
    for field in schema:
        if field.name not in raw.columns:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        text = F.col(f"`{field.name}`")
        kind = PAY if isinstance(field.dataType, T.DecimalType) else field.dataType
        value = text if isinstance(kind, T.StringType) else F.trim(text).try_cast(kind)
        columns.append(value.alias(field.name))
        if not isinstance(kind, T.StringType):
            failed.append(F.when(value.isNull() & (F.trim(text) != ""), text).alias(field.name))
    columns += [F.col(f"`{name}`") for name in raw.columns if name not in known]
    if failed:
        written = F.to_json(F.struct(*failed))  # NULL fields are left out
        columns.append(F.when(written != "{}", written).alias(REJECTED))
    return raw.select(*columns)


def write_star(star: Star, path: str, format: str = "parquet") -> None:
    """The four tables as one folder each; ``csv`` writes a header."""
    for name, table in star.tables().items():
        writer = table.write.mode("overwrite")
        if format == "csv":
            writer = writer.option("header", True).option("escape", '"')
        writer.format(format).save(f"{path}/{name}")


def read_star(spark: SparkSession, path: str, format: str = "parquet") -> Star:
    """A dataset written by :func:`write_star`."""
    tables = {}
    for name, schema in _TABLE_SCHEMAS.items():
        reader = spark.read.schema(schema).format(format)
        if format == "csv":
            reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
        tables[name] = reader.load(f"{path}/{name}")
    return Star(
        fact=tables["job_postings_fact"],
        company=tables["company_dim"],
        skill=tables["skills_dim"],
        bridge=tables["skills_job_dim"],
    )


def save_star_tables(star: Star, database: str, buckets: int) -> Star:
    """Catalog tables with fact and bridge bucketed and sorted by posting, so that their join moves no data.

    Choose ``buckets`` so that one bucket of the bridge fits a task's memory several times.
    """
    spark = star.fact.sparkSession
    for name, table in star.tables().items():
        # One task per bucket, so that a bucket is one file.
        by_posting = "job_id" in table.columns
        writer = (table.repartition(buckets, "job_id") if by_posting else table).write.mode("overwrite")
        if by_posting:
            writer = writer.bucketBy(buckets, "job_id").sortBy("job_id")
        writer.saveAsTable(f"{database}.{name}")
    return Star(
        fact=spark.table(f"{database}.job_postings_fact"),
        company=spark.table(f"{database}.company_dim"),
        skill=spark.table(f"{database}.skills_dim"),
        bridge=spark.table(f"{database}.skills_job_dim"),
    )


def run_catalog(star: Star, analyses: Mapping[str, Callable[[Star], DataFrame]], path: str) -> dict[str, bool]:
    """Write each analysis of a dataset as CSV with header; returns whether it has rows.

    Rows are counted while they are written, so an analysis is computed once and its result is not read again.
    """
    filled = {}
    for name, analysis in analyses.items():
        written = Observation()
        result = analysis(star).observe(written, F.count(F.lit(1)).alias("rows"))
        result.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{name}")
        filled[name] = observed(written)["rows"] > 0
    return filled
