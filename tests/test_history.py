from pathlib import Path

from pyspark.sql import functions as F
from rowtools import as_tuples

from postprism.operators import table_changes
from postprism.operators.history import append_history, append_indexed, indexed_keys
from postprism.plans import calendar


def test_collections_are_kept(spark, tmp_path):
    path = str(tmp_path / "history")

    def collect(number, rows):
        return append_history(
            spark, path, spark.createDataFrame(rows, "company string, title string, seen int"), number, ["company", "title"]
        )

    collect(1, [("a", "x", 1), (None, "y", 1)])
    collect(2, [("a", "x", 2), ("b", "x", 2), (None, "y", 2)])
    whole = collect(3, [("b", "x", 3), ("a", "z", 3)])
    expected = [(1, None, "y", 1), (1, "a", "x", 1), (2, "b", "x", 2), (3, "a", "z", 3)]

    def rows(df):
        return sorted(as_tuples(df, "collection_id", "company", "title", "seen"), key=str)

    assert rows(whole) == sorted(expected, key=str)
    # Repeating the last collection changes nothing.
    assert rows(collect(3, [("b", "x", 3), ("a", "z", 3)])) == sorted(expected, key=str)


def test_table_changes(spark):
    applied = spark.createDataFrame(
        [(1, "resume_01", None), (2, "resume_02", "c2"), (3, "resume_03", "x")], "job_id int, resume string, cover string"
    )
    changed = table_changes.add_column(applied, "contact")
    assert changed.schema["contact"].dataType.simpleString() == "string"
    assert changed.where(F.col("contact").isNotNull()).count() == 0
    updates = spark.createDataFrame([(1, "Ann"), (3, None), (9, "nobody")], "job_id int, contact string")
    changed = table_changes.update_by_key(changed, updates, "job_id", "contact")
    again = spark.createDataFrame([(2, "Bo"), (1, "Al")], "job_id int, contact string")
    changed = table_changes.update_by_key(changed, again, "job_id", "contact")
    changed = table_changes.update_by_key(
        changed, spark.createDataFrame([(2, None)], "job_id int, cover string"), "job_id", "cover"
    )
    changed = table_changes.rename_column(changed, "contact", "contact_name")
    changed = table_changes.change_type(changed, "job_id", "string")
    assert sorted(as_tuples(changed), key=str) == [
        ("1", "resume_01", None, "Al"), ("2", "resume_02", None, "Bo"), ("3", "resume_03", "x", None),
    ]
    assert table_changes.drop_column(changed, "contact_name").columns == ["job_id", "resume", "cover"]
    assert as_tuples(table_changes.change_type(changed.limit(1), "resume", "int"), "resume") == [(None,)]


def test_indexed_collections_equal_plain_ones(spark, tmp_path):
    kinds = "company string, title string, seen int"

    def both(number, rows):
        collection = spark.createDataFrame(rows, kinds)
        plain = append_history(spark, str(tmp_path / "plain"), collection, number, ["company", "title"])
        indexed = append_indexed(spark, str(tmp_path / "indexed"), collection, number, ["company", "title"], buckets=16)
        columns = ("collection_id", "company", "title", "seen")
        assert sorted(as_tuples(indexed, *columns), key=str) == sorted(as_tuples(plain, *columns), key=str)
        return indexed

    both(1, [(f"c{i}", "x", 1) for i in range(200)] + [(None, "y", 1)])
    second = [("c7", "x", 2), ("d", "x", 2), (None, "y", 2), ("e", None, 2)]
    both(2, second)
    both(3, [("d", "x", 3), ("e", None, 3), ("f", "x", 3)])
    assert both(2, second).count() == 204  # repeated: its own keys are no history
    asked = indexed_keys(spark, str(tmp_path / "indexed"), spark.createDataFrame([("c7", "x", 4)], kinds), ["company", "title"], 4, 16)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]
    assert 0 < asked.count() < 60


def test_updates_rewrite_their_months_only(spark, tmp_path):
    path = str(tmp_path / "by_month")
    fact = spark.range(240).select(
        F.col("id").alias("job_id"),
        F.lit("old").alias("job_via"),
        F.when(F.col("id") != 239, F.make_date(F.lit(2023), (F.col("id") % 12 + 1).cast("int"), F.lit(5)).cast("timestamp_ntz")).alias("job_posted_date"),
    )
    calendar.write_by_month(fact, path)

    def files():
        return {str(file.relative_to(path)) for file in Path(path).rglob("part-*.parquet")}

    before = files()
    updates = spark.createDataFrame([(1, "new"), (13, None), (6, "new"), (239, "new"), (9_999, "new")], "job_id long, job_via string")
    assert calendar.update_by_month(spark.read.parquet(path), path, updates, "job_id", "job_via") == [2, 7, None]
    stored = spark.read.parquet(path)
    got = dict(as_tuples(stored.where("job_via is null or job_via <> 'old'"), "job_id", "job_via"))
    assert stored.count() == 240 and got == {1: "new", 13: None, 6: "new", 239: "new"}
    kept = {file for file in before if not any(f"posted_month={month}/" in file for month in (2, 7, "__HIVE_DEFAULT_PARTITION__"))}
    assert kept <= files() and len(kept) < len(before)
    assert calendar.update_by_month(stored, path, updates.where("job_id = 9999"), "job_id", "job_via") == []
    calendar.write_by_month(fact.where("job_id % 12 = 0").withColumn("job_via", F.lit("again")), path)  # a second load
    assert spark.read.parquet(path).where("job_via = 'again'").count() == 20 and spark.read.parquet(path).count() == 240
