"""Every query by name, over the order tables: name -> function of (session, folder)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postprism.functions.dates import posting_time
from postprism.functions.text import classify_title, clean_text, strip_markup
from postprism.operators import conform, prepare, table_changes
from postprism.operators.history import append_history, append_indexed
from postprism.operators.keys import first_seen_dimension
from postprism.operators.population import population_funnel
from postprism.operators.terms import BROADCAST_TERMS, extract_terms, usable_vocabulary
from postprism.plans import calendar, demand, pay, quality, trend
from postprism.session import work_folder
from postprism.sources import feeds, postings, testdata
from postprism.star import Star
from postprism.streaming import intake

Query = Callable[[SparkSession, str], DataFrame]
ROLE = testdata.MAIN_ROLE
FILE_POSTINGS = 1_000_000  # one posting file a million postings
COLLECTED_AT = datetime(2024, 2, 1, 12, 0, 0)
SPLIT_DATE = "1998-04-15 00:00:00"
# Words and rules for the test titles; the SQL states its own.
TITLE_WORDS = ("the", "nicht", "de", "and", "el")
PAGE_RULES = (("nicht", "German"), ("the", "English"), ("que", "Romance"), ("de", "Romance"))
PART_RULES = (("small", "Small thing"), ("red", "Red thing"), ("ring", "Ring"), ("g", "Thing with g"))


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for results compared across engines."""
    return df.select(
        *[
            F.col(field.name).cast("double").alias(field.name) if isinstance(field.dataType, T.DecimalType) else F.col(field.name)
            for field in df.schema
        ]
    )


def _on_star(analysis: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, folder: analysis(testdata.star(spark, folder))


def _on_table(name: str, step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: step(testdata.table(spark, folder, name))


def _halves(star: Star) -> tuple[Star, Star]:
    cut = F.lit(SPLIT_DATE).cast("timestamp_ntz")
    posted = F.col("job_posted_date")
    return star.with_fact(star.fact.where(posted < cut)), star.with_fact(star.fact.where(posted >= cut))


def _keyed(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.key_postings(prepare.full_row_dedup(testdata.wide_rows(spark, folder)))


def _fact(spark: SparkSession, folder: str) -> DataFrame:
    keyed = _keyed(spark, folder)
    return prepare.build_fact(keyed, prepare.company_dimension(keyed))


def _bridge(spark: SparkSession, folder: str) -> DataFrame:
    keyed = _keyed(spark, folder)
    skill = prepare.skill_dimension(prepare.explode_skills(keyed))
    return prepare.build_bridge(keyed, skill, prepare.build_fact(keyed, prepare.company_dimension(keyed)))


def _load_audit(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, testdata.wide_rows(spark, folder))


def _audit(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The star is written once; its rows are counted as they are written."""
    path = work_folder(spark, "audited-star")
    return prepare.load_star(rows, lambda star: postings.write_star(star, path))


def _counted_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts from the stored tables."""
    rows, path = testdata.wide_rows(spark, folder), work_folder(spark, "counted-star")
    star, keyed = prepare.build_star(rows)
    postings.write_star(star, path)
    return prepare.load_audit(rows, keyed, postings.read_star(spark, path))


def _damaged_star(spark: SparkSession, folder: str) -> Star:
    """Companies lost and nameless, skills lost and repeated, postings and pairs repeated, pairs without a skill."""
    star = testdata.star(spark, folder)
    customers = testdata.table(spark, folder, "customer").where(F.col("c_acctbal") >= -900)
    twice = star.fact.where(F.col("job_schedule_type") == "Part-time")
    return Star(
        fact=star.fact.union(twice),
        company=customers.select(
            F.col("c_custkey").alias("company_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name")
        ),
        skill=star.skill.where(~F.col("skills").endswith("BRASS")).union(star.skill.where(F.col("skills").startswith("Brand#1 "))),
        bridge=star.bridge.union(star.bridge.where("skill_id < 20")).union(
            twice.select("job_id", F.lit(None).cast("bigint").alias("skill_id"))
        ),
    )


def _csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "postings-csv")
    testdata.wide_rows(spark, folder).write.option("header", True).option("escape", '"').csv(path)
    return _plain(postings.read_postings_csv(spark, path).drop(postings.REJECTED))


def _csv_in_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose titles hold line breaks, commas and quotes, read in parts; one file up to so many postings.

    The rows are shuffled to the files, not joined and sorted by the task that writes a file.
    """
    path = work_folder(spark, "postings-csv-parts")
    title = F.concat(F.lit('"'), F.col("job_title"), F.lit('", noted\n'), F.col("job_via"))
    rows = testdata.wide_rows(spark, folder).withColumn("job_title", title)
    files = testdata.table(spark, folder, "orders").count() // FILE_POSTINGS + 1
    rows.repartition(files, "job_posted_date", "company_name").write.option("header", True).option("escape", '"').csv(path)
    return _plain(postings.read_postings_csv(spark, path, whole_file_bytes=0).drop(postings.REJECTED))


def _damaged_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Posting files with the columns in reverse order, one more column, and pay that is no number in insured postings."""
    path = work_folder(spark, "postings-csv-extra")
    rows = testdata.wide_rows(spark, folder)
    pay = F.col("salary_year_avg").cast("string")
    damaged = rows.withColumn("salary_year_avg", F.when(F.col("job_health_insurance"), F.concat(F.lit("$"), pay)).otherwise(pay))
    columns = [F.concat("job_title", F.lit(" noted")).alias("note"), *reversed(rows.columns)]
    damaged.select(*columns).write.option("header", True).option("escape", '"').csv(path)
    return postings.read_postings_csv(spark, path)


def _audit_of_damaged_csv(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, _damaged_csv(spark, folder))


def _stated_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates as feeds may state them: epoch seconds, epoch milliseconds, or nothing that can be read."""
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    status = F.col("o_orderstatus")
    posted = F.when(status == "F", seconds.cast("string")).when(status == "O", (seconds * 1000).cast("string")).otherwise("soon")
    return testdata.table(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source"), posted.alias("posted"))


def _star_files(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "star-csv")
    postings.write_star(testdata.star(spark, folder), path, format="csv")
    star = postings.read_star(spark, path, format="csv")
    return _plain(
        star.fact.select("job_id", "company_id", "salary_year_avg")
        .join(star.company, "company_id")
        .join(star.bridge, "job_id", "left")
        .join(star.skill, "skill_id", "left")
        .select("job_id", F.col("name").alias("company_name"), F.col("skills").alias("skill"), "salary_year_avg")
    )


def _by_month(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "postings-by-month")
    calendar.write_by_month(testdata.postings(spark, folder), path)
    stored = _plain(calendar.month_partition(spark.read.parquet(path), 2))
    return stored.withColumn("posted_month", F.col("posted_month").cast("bigint"))


def _conform_feed(spark: SparkSession, folder: str) -> DataFrame:
    records, _ = feeds.read_feeds(spark, testdata.land_payloads(spark, folder))
    return records.drop("arrival")


def _page_star(spark: SparkSession, folder: str) -> Star:
    return conform.conform_star(
        testdata.page_records(spark, folder),
        testdata.vocabulary(spark, folder),
        COLLECTED_AT,
        terms=TITLE_WORDS,
        rules=PAGE_RULES,
    )


def _page_fact(spark: SparkSession, folder: str) -> DataFrame:
    records = conform.role_filter(testdata.page_records(spark, folder), TITLE_WORDS)
    numbered = conform.number_postings(conform.keep_first(records, conform.posting_key()))
    company = first_seen_dimension(numbered, "company", "job_id", "company_id")
    return _plain(conform.conform_fact(numbered, company, COLLECTED_AT, PAGE_RULES))


def _first_documents(documents: DataFrame) -> DataFrame:
    records = documents.select("doc_id", F.col("lang").alias("company"), F.col("text").alias("title"))
    kept = conform.keep_first(records, conform.posting_key(), order="doc_id")
    return kept.select("doc_id", F.col("company").alias("lang"), F.col("title").alias("text"))


def _document_terms(spark: SparkSession, folder: str, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    terms = usable_vocabulary(testdata.vocabulary(spark, folder))
    return extract_terms(testdata.table(spark, folder, "documents"), terms, "doc_id", broadcast_terms=broadcast_terms)


def _collections(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "history")
    events = testdata.table(spark, folder, "events").select("event_id", "ts", "user_id")
    first = events.where(F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    second = events.where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    append_history(spark, path, first, 1, ["event_id"])
    return append_history(spark, path, second, 2, ["event_id"])


def _indexed_collections(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "indexed-history")
    events = testdata.table(spark, folder, "events").select("event_id", "ts", "user_id")
    first = events.where(F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    second = events.where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    append_indexed(spark, path, first, 1, ["event_id"])
    return append_indexed(spark, path, second, 2, ["event_id"])


def _updated_months(spark: SparkSession, folder: str) -> DataFrame:
    """Boards of dear postings of the first quarter are renamed where they are stored."""
    path = work_folder(spark, "updated-by-month")
    fact = testdata.postings(spark, folder).select("job_id", "job_via", "job_posted_date")
    calendar.write_by_month(fact, path)
    dear = testdata.table(spark, folder, "orders").where((F.month("o_orderdate") <= 3) & (F.col("o_totalprice") > 300000))
    updates = dear.select(F.col("o_orderkey").alias("job_id"), F.lit("board X").alias("job_via"))
    calendar.update_by_month(spark.read.parquet(path), path, updates, "job_id", "job_via")
    return spark.read.parquet(path).select("job_id", "job_via", F.col("posted_month").cast("bigint"))


def _changed_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = testdata.table(spark, folder, "orders")
    customers = testdata.table(spark, folder, "customer").where(F.col("c_mktsegment") == "BUILDING")
    contacts = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", F.col("c_name").alias("contact")
    )
    changed = table_changes.add_column(orders, "contact")
    changed = table_changes.update_by_key(changed, contacts, "o_orderkey", "contact")
    changed = table_changes.rename_column(changed, "contact", "contact_name")
    changed = table_changes.change_type(changed, "o_orderdate", "date")
    return table_changes.drop_column(changed, "o_orderpriority")


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    events = testdata.table(spark, folder, "events")
    # The table is one file in the folder or a folder of its own.
    parent, name = events.inputFiles()[0].rsplit("/", 1)
    return intake.landed_files(spark, parent, events.schema, name if name == "events.parquet" else "*.parquet")


def _stream_intake(spark: SparkSession, folder: str) -> DataFrame:
    stream = _event_stream(spark, folder).select("event_id", "ts", "user_id", "event_type")
    path = work_folder(spark, "intake")
    intake.append_stream(stream, path, work_folder(spark, "intake-state"), collection_id=1)
    return spark.read.parquet(path)


def _stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    first = intake.dedup_stream(_event_stream(spark, folder), ["user_id", "event_type"], "ts", "60 days")
    return intake.run_to_table(
        first.select("user_id", "event_type"), work_folder(spark, "dedup"), work_folder(spark, "dedup-state")
    )


def _stream_dedup_history(spark: SparkSession, folder: str) -> DataFrame:
    """First arrivals of (user, kind) that the collection of the first weeks does not hold."""
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, intake.STATE_STORE)
    try:
        events = _event_stream(spark, folder).select("event_id", "user_id", "event_type")
        stored = testdata.table(spark, folder, "events").where(F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
        first = intake.dedup_against_history(events, ["user_id", "event_type"], ["event_id"], stored)
        return intake.run_to_table(first, work_folder(spark, "first"), work_folder(spark, "first-state"))
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)


def _stream_trend(spark: SparkSession, folder: str) -> DataFrame:
    counts = intake.window_counts(_event_stream(spark, folder), "ts", "event_type", "7 days", "60 days")
    return intake.window_shares(
        intake.run_updates(counts, work_folder(spark, "trend"), work_folder(spark, "trend-state"))
    )


def queries() -> dict[str, Query]:
    return {
        # Pay
        "top_paying": _on_star(lambda star: pay.top_paying(star, ROLE)),
        "pay_by_skill": _on_star(lambda star: pay.pay_by_skill(star, ROLE)),
        "demand_and_pay": _on_star(lambda star: pay.demand_and_pay(star, ROLE)),
        "pay_unguarded": _on_star(lambda star: pay.pay_unguarded(star, ROLE)),
        "quadrants": _on_star(lambda star: pay.quadrants(pay.demand_and_pay(star, ROLE))),
        "pay_distribution": _on_star(lambda star: pay.pay_distribution(star, ROLE)),
        "salary_outliers": _on_star(lambda star: pay.salary_outliers(star, ROLE)),
        "outlier_effect": _on_star(lambda star: pay.outlier_effect(star, ROLE)),
        # Demand
        "skills_in_top": _on_star(lambda star: demand.skills_in_top(star, ROLE)),
        "skill_demand_top": _on_star(lambda star: demand.skill_demand_top(star, ROLE)),
        "skill_demand_all": _on_star(lambda star: demand.skill_demand_all(star, ROLE)),
        "remote_skill_count": _on_star(lambda star: demand.remote_skill_count(star, ROLE)),
        "demand_leaders": _on_star(lambda star: demand.demand_leaders(demand.skill_demand_all(star, ROLE), cut=3.0)),
        "top_paying_marked": _on_star(lambda star: demand.mark_top(pay.top_paying(star, ROLE), "salary_year_avg")),
        "skills_in_top_marked": _on_star(lambda star: demand.mark_common(demand.skills_in_top(star, ROLE), 2)),
        "compare_demand": _on_star(
            lambda star: demand.compare_demand(*_halves(star), ROLE, excluded=("Brand#1 LARGE", "Brand#2 SMALL"))
        ),
        "demand_trend": _on_star(lambda star: trend.demand_trend(star, ROLE)),
        # Quality
        "population_funnel": _on_star(lambda star: population_funnel(star, ROLE)),
        "flag_equivalence": _on_star(quality.flag_equivalence),
        "top_without_skills": _on_star(lambda star: quality.top_without_skills(star, ROLE)),
        "near_duplicates": _on_star(quality.near_duplicates),
        "near_duplicates_by_role": _on_star(
            lambda star: quality.near_duplicates(star, ("company_id", "job_title_short", "job_location"))
        ),
        "integrity_report": _on_star(quality.integrity_report),
        "integrity_report_damaged": lambda spark, folder: quality.integrity_report(_damaged_star(spark, folder)),
        "location_buckets": _on_star(lambda star: quality.location_buckets(star, ROLE)),
        "companies_without_degree": _on_star(quality.companies_without_degree),
        "company_counts": _on_star(quality.company_counts),
        # Calendar
        "insured_in_quarter": _on_star(calendar.insured_in_quarter),
        "insured_by_company": _on_star(calendar.insured_by_company),
        "avg_by_schedule": _on_star(lambda star: calendar.avg_by_schedule(star, after="1996-06-01")),
        "postings_per_month": _on_table("events", lambda events: calendar.postings_per_month(events, "ts")),
        "first_rows": _on_table(
            "events", lambda events: calendar.first_rows(events, ["event_id", "ts"], ["ts", "event_id"])
        ),
        "date_parts": _on_table("events", lambda events: calendar.date_parts(events.select("event_id", "ts"), "ts")),
        "month_partition": _by_month,
        "month_union": _on_star(lambda star: calendar.month_union(star.fact)),
        "quarter_top": _on_star(lambda star: calendar.quarter_top(star.fact, ROLE)),
        # Preparation
        "full_row_dedup": _on_table("documents", lambda docs: prepare.full_row_dedup(docs.select("text", "lang"))),
        "full_row_dedup_lines": _on_table(
            "lineitem", lambda lines: prepare.full_row_dedup(lines.select("l_orderkey", "l_partkey"))
        ),
        "read_postings_csv": _csv_rows,
        "read_postings_csv_extra": lambda spark, folder: _plain(_damaged_csv(spark, folder)),
        "read_postings_csv_parts": _csv_in_parts,
        "load_audit_csv": _audit_of_damaged_csv,
        "load_audit_tables": _counted_tables,
        "write_star": _star_files,
        "surrogate_key": lambda spark, folder: _plain(_keyed(spark, folder)),
        "company_dimension": lambda spark, folder: prepare.company_dimension(testdata.wide_rows(spark, folder)),
        "skill_dimension": lambda spark, folder: prepare.skill_dimension(prepare.explode_skills(_keyed(spark, folder))),
        "explode_skills": lambda spark, folder: prepare.explode_skills(_keyed(spark, folder)),
        "build_fact": lambda spark, folder: _plain(_fact(spark, folder)),
        "build_bridge": _bridge,
        "load_audit": _load_audit,
        "date_span": lambda spark, folder: prepare.date_span(_fact(spark, folder)),
        # Feeds
        "clean_text": _on_table(
            "pages",
            lambda pages: pages.select(
                "page_id", clean_text(F.regexp_replace("html", "<[^>]+>", " ")).alias("cleaned")
            ),
        ),
        "strip_markup": _on_table(
            "pages", lambda pages: pages.select("page_id", strip_markup(F.col("html")).alias("text"))
        ),
        "conform_feed": _conform_feed,
        "feed_audit": lambda spark, folder: feeds.feed_audit(spark, testdata.land_payloads(spark, folder)),
        "role_filter": lambda spark, folder: conform.role_filter(
            testdata.page_records(spark, folder), TITLE_WORDS
        ).select("arrival", "title"),
        "classify_title": _on_table(
            "part",
            lambda parts: parts.select(
                "p_partkey", "p_name", classify_title(F.col("p_name"), PART_RULES).alias("role")
            ),
        ),
        "keep_first_dedup": _on_table("documents", _first_documents),
        "conform_funnel": lambda spark, folder: conform.conform_funnel(
            testdata.page_records(spark, folder), TITLE_WORDS
        ),
        "extract_terms": _document_terms,
        "extract_terms_shuffled": lambda spark, folder: _document_terms(spark, folder, broadcast_terms=0),
        "posting_dates": lambda spark, folder: conform.posting_dates(_stated_dates(spark, folder)),
        "posting_times": lambda spark, folder: _stated_dates(spark, folder).select(
            "o_orderkey", posting_time(F.col("posted")).alias("posted")
        ),
        "first_seen_dimension": _on_table(
            "documents", lambda docs: first_seen_dimension(docs, "source", "doc_id", "company_id")
        ),
        "conform_fact": _page_fact,
        "coverage_report": lambda spark, folder: conform.coverage_report(_page_star(spark, folder)),
        "append_history": _collections,
        "append_history_indexed": _indexed_collections,
        "update_by_month": _updated_months,
        "table_changes": _changed_orders,
        # Streams
        "stream_intake": _stream_intake,
        "stream_dedup": _stream_dedup,
        "stream_dedup_history": _stream_dedup_history,
        "stream_trend": _stream_trend,
    }
