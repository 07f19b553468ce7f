"""Schemas of the source rows, the star and the feed payloads."""

from pyspark.sql import types as T

# Column names and types of the posting table.
_POSTING_HEAD = [
    T.StructField("job_title_short", T.StringType()),
    T.StructField("job_title", T.StringType()),
    T.StructField("job_location", T.StringType()),
    T.StructField("job_via", T.StringType()),
    T.StructField("job_schedule_type", T.StringType()),
    T.StructField("job_work_from_home", T.BooleanType()),
    T.StructField("search_location", T.StringType()),
    T.StructField("job_posted_date", T.TimestampNTZType()),
    T.StructField("job_no_degree_mention", T.BooleanType()),
    T.StructField("job_health_insurance", T.BooleanType()),
    T.StructField("job_country", T.StringType()),
    T.StructField("salary_rate", T.StringType()),
    T.StructField("salary_year_avg", T.DecimalType(12, 2)),
    T.StructField("salary_hour_avg", T.DecimalType(10, 2)),
]

FACT = T.StructType(
    [T.StructField("job_id", T.LongType(), False), T.StructField("company_id", T.LongType(), False), *_POSTING_HEAD]
)
COMPANY = T.StructType([T.StructField("company_id", T.LongType(), False), T.StructField("name", T.StringType(), False)])
SKILL = T.StructType([T.StructField("skill_id", T.LongType(), False), T.StructField("skills", T.StringType(), False)])
BRIDGE = T.StructType([T.StructField("job_id", T.LongType(), False), T.StructField("skill_id", T.LongType(), False)])

WIDE = T.StructType(
    [*_POSTING_HEAD, T.StructField("company_name", T.StringType()), T.StructField("job_skills", T.StringType())]
)

POSTING_COLUMNS = [field.name for field in _POSTING_HEAD]

FEED_RECORD = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("remote", T.BooleanType()),
        T.StructField("schedule", T.StringType()),
        T.StructField("posted", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)
