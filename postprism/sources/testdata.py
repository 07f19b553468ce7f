"""The order tables seen as a posting dataset (see FIXTURES.md, part C).

Orders are postings, customers are companies, brand and type of a part are a skill, and the lines of
an order list its skills. The tables hold no NULLs, so rules on weekday and month leave some
attributes unstated. Every fact column comes from the orders table alone: no join is paid for
columns a query does not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postprism.functions.text import clean_text, strip_markup
from postprism.operators.keys import surrogate_key
from postprism.schemas import POSTING_COLUMNS
from postprism.session import work_folder
from postprism.star import Star

MAIN_ROLE = "1-URGENT"
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _iso_weekday():
    return F.weekday("o_orderdate") + 1


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """Fact table from orders."""
    status, month, day = F.col("o_orderstatus"), F.month("o_orderdate"), _iso_weekday()
    price = F.col("o_totalprice")
    place = (
        F.when(status == "O", "Anywhere")
        .when(day == 7, F.lit(None))
        .when(status == "F", "New York, NY")
        .otherwise("Chicago, IL")
    )
    schedule = (
        F.when(month == 1, F.lit(None))
        .when(month <= 5, "Full-time")
        .when(month <= 8, "Internship")
        .when(month <= 11, "Contractor")
        .otherwise("Part-time")
    )
    columns = {
        "job_title_short": F.col("o_orderpriority"),
        "job_title": F.concat_ws(" ", "o_orderpriority", F.year("o_orderdate").cast("string")),
        "job_location": place,
        "job_via": F.concat(F.lit("board "), status),
        "job_schedule_type": schedule,
        "job_work_from_home": status == "O",
        "search_location": F.when(status == "F", "New York, NY").otherwise("Chicago, IL"),
        "job_posted_date": F.col("o_orderdate"),
        "job_no_degree_mention": price < 100000,
        "job_health_insurance": price > 300000,
        "job_country": F.when(day != 7, "United States"),
        "salary_rate": F.when(day <= 2, "year").when(day == 3, "hour"),
        "salary_year_avg": F.when(day <= 2, price.cast("decimal(12,2)")),
        "salary_hour_avg": F.when(day == 3, (F.round(price).cast("decimal(10,0)") / 100).cast("decimal(10,2)")),
    }
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("company_id"),
        *[columns[name].alias(name) for name in POSTING_COLUMNS],
    )


def companies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"))


def _part_skills(spark: SparkSession, folder: str) -> DataFrame:
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("bigint")
    kind = F.array_position(F.array(*[F.lit(name) for name in PART_TYPES]), F.col("p_type"))
    return table(spark, folder, "part").select(
        "p_partkey", (number * 10 + kind).alias("skill_id"), F.concat_ws(" ", "p_brand", "p_type").alias("skills")
    )


def skills(spark: SparkSession, folder: str) -> DataFrame:
    return _part_skills(spark, folder).select("skill_id", "skills").distinct()


def listed_skills(spark: SparkSession, folder: str) -> DataFrame:
    """Unique (posting, skill) pairs.

    Gathered per posting, repeats dropped map-side, so the lines are shuffled once and by posting, which is also
    how the analyses join them. A posting's list is no longer than the 150 skills.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    parts = _part_skills(spark, folder).select("p_partkey", "skill_id")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy(F.col("l_orderkey").alias("job_id"))
        .agg(F.collect_set("skill_id").alias("ids"))
        .select("job_id", F.explode("ids").alias("skill_id"))
    )


def star(spark: SparkSession, folder: str) -> Star:
    return Star(
        fact=postings(spark, folder),
        company=companies(spark, folder),
        skill=skills(spark, folder),
        bridge=listed_skills(spark, folder),
    )


def wide_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Denormalised rows without keys, as a source file would hold them.

    Part-time postings appear twice (full-row duplicates) and customers far in debt have no name.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    parts = _part_skills(spark, folder).select("p_partkey", "skills")
    lists = (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy(F.col("l_orderkey").alias("job_id"))
        .agg(F.array_sort(F.collect_list("skills")).alias("items"))
        .select("job_id", F.concat(F.lit("['"), F.array_join("items", "', '"), F.lit("']")).alias("job_skills"))
    )
    names = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("company_id"), F.when(F.col("c_acctbal") >= -900, F.col("c_name")).alias("company_name")
    )
    rows = (
        postings(spark, folder)
        .join(names, "company_id")
        .join(lists, "job_id", "left")
        .withColumn("copies", F.when(F.col("job_schedule_type") == "Part-time", F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
        .withColumn("copy", F.explode("copies"))
    )
    return rows.select(*POSTING_COLUMNS, "company_name", "job_skills")


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages as feed records: the title element is the title, the host the company."""
    url, html = F.col("url"), F.col("html")
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("arrival"),
        F.lit("pages").alias("source"),
        clean_text(strip_markup(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1))).alias("title"),
        clean_text(F.regexp_extract(url, "^https?://([^/]+)/", 1)).alias("company"),
        clean_text(F.regexp_extract(url, "^https?://[^/]+/([a-z]+)/", 1)).alias("location"),
        url.startswith("https:").alias("remote"),
        F.lit(None).cast("string").alias("schedule"),
        F.lit(None).cast("string").alias("posted"),
        strip_markup(html).alias("text"),
        url.alias("url"),
    )


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct words of the benchmark texts as a skill dimension."""
    words = F.explode(F.split(F.lower("text"), r"[\s.,]+"))
    distinct = table(spark, folder, "benchmark").select(words.alias("skills")).where(F.col("skills") != "").distinct()
    return surrogate_key(distinct, "skill_id", ["skills"])


def land_payloads(spark: SparkSession, folder: str, per_payload: int = 500) -> dict[str, str]:
    """Pages and documents written as landed payloads of the four feed shapes; returns feed -> folder.

    One packed file per payload of at most ``per_payload`` items, as an API would page and send them.
    """
    url, html = F.col("url"), F.col("html")
    title = F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)
    host = F.regexp_extract(url, "^https?://([^/]+)/", 1)
    place = F.regexp_extract(url, "^https?://[^/]+/([a-z]+)/", 1)
    pages, documents = table(spark, folder, "pages"), table(spark, folder, "documents")
    page_no, doc_no = F.floor(F.col("page_id") / per_payload), F.floor(F.col("doc_id") / per_payload)
    english = F.col("lang") == "en"

    items = {
        "arbeitnow": (pages, page_no, "page_id", "data", F.struct(
            title.alias("title"), host.alias("company_name"), place.alias("location"),
            url.startswith("https:").alias("remote"),
            F.array(F.lit("full"), F.col("page_id").cast("string")).alias("job_types"),
            F.col("page_id").alias("created_at"), html.alias("description"), url.alias("url"))),
        "jobicy": (documents, doc_no, "doc_id", "jobs", F.struct(
            F.col("text").alias("jobTitle"), F.col("source").alias("companyName"), F.col("lang").alias("jobGeo"),
            F.when(english, F.array("source", "lang")).otherwise(F.array()).alias("jobType"),
            F.col("n_chars").alias("pubDate"), F.col("text").alias("jobDescription"),
            F.concat(F.lit("doc:"), F.col("doc_id")).alias("url"))),
        "remoteok": (pages, page_no, "page_id", None, F.struct(
            title.alias("position"), host.alias("company"), place.alias("location"),
            F.lit("2024-01-05T00:00:00").alias("date"), html.alias("description"), url.alias("url"))),
        "himalayas": (documents, doc_no, "doc_id", "jobs", F.struct(
            F.col("lang").alias("title"), F.col("source").alias("companyName"),
            F.when(english, F.array("lang", "source")).alias("locationRestrictions"),
            F.lit(" ").alias("employmentType"), F.col("n_chars").alias("pubDate"),
            F.col("text").alias("description"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("applicationLink"))),
    }
    landed = {}
    for feed, (rows, number, key, envelope, item) in items.items():
        # The table's columns move once, before texts are repeated in the items.
        dealt = rows.withColumn("payload_no", F.format_string("%09d", number)).repartition("payload_no")
        grouped = dealt.groupBy("payload_no").agg(
            F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), item.alias("item")))).alias("rows")
        )
        payload = F.transform("rows", lambda row: F.to_json(row["item"]))
        text = F.concat(F.lit("["), F.array_join(payload, ",\n"), F.lit("]"))
        if envelope:
            text = F.concat(F.lit('{"' + envelope + '":'), text, F.lit("}"))
        else:
            # The list's first item is the feed's own notice.
            text = F.concat(F.lit('[{"legal":"terms of use"},\n'), F.array_join(payload, ",\n"), F.lit("]"))
        landed[feed] = work_folder(spark, f"landed-{feed}")
        grouped.select(text.alias("value"), "payload_no").write.partitionBy("payload_no").text(landed[feed], compression="gzip")
    return landed
