import random
from collections import Counter

import pytest
from rowtools import as_tuples

from postprism.schemas import WIDE
from postprism.sources import postings
from postprism.sources.records import inside_after, read_quoted_csv, records_of


def whole_files(spark, path):
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)


@pytest.fixture
def small_parts(spark):
    def set_size(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def check(spark, path):
    got, want = read_quoted_csv(spark, path), whole_files(spark, path)
    assert got.columns == want.columns
    assert sorted(map(str, as_tuples(got))) == sorted(map(str, as_tuples(want)))
    return got


def test_inside_after():
    for line, inside, after in [
        ("a,b", False, False), ('a,"b', False, True), ('"a""', False, True), ('"a"""', False, False), ('a"b,c', False, False),
        ('x""', True, True), ('x"', True, False), ('x",y,"', True, True), ('5" pipe,"a,b"', False, False), ("", True, True), ('"', False, True),
    ]:
        assert inside_after(line, inside) is after, line


TEXT = 'id,"na""me",note\n1,"a,b","two\nlines"\n2,"say ""x""\n\n,"",y",plain\n\n3,,"",\n4,"""",5" pipe\n5,"no\nend ""\n""of\nit"\n6,x,"last"\n'


def parts(text, size, number):
    """The lines of a text as if it were read in parts of so many bytes."""
    at, rows = 0, []
    for line in text.removesuffix("\n").split("\n"):
        rows.append((line, number, at // size * size))
        at += len(line.encode()) + 1
    return rows


def records(text):
    """Plain reassembly: a record ends where its quotes are closed."""
    out, held = [], ""
    for line in text.removesuffix("\n").split("\n"):
        held += line
        inside = False
        for one in held.split("\n"):
            inside = inside_after(one, inside)
        if inside:
            held += "\n"
        else:
            out += [held] if held else []
            held = ""
    return out + ([held.removesuffix("\n")] if held else [])


def cut_everywhere(spark, texts):
    """Each text in parts of every size up to its own, all in one run."""
    rows, want, headers, number = [], Counter(), Counter(), 0
    for text in texts:
        for size in [*range(1, 40), *range(40, len(text.encode()), 23)]:
            number += 1
            rows += parts(text, size, number)
            want.update(records(text))
            headers[records(text)[0]] += 1
    got = as_tuples(records_of(spark.createDataFrame(rows, "value string, _file long, _start long").coalesce(1)))
    assert Counter(row[0] for row in got) == want
    assert Counter(row[0] for row in got if row[1]) == headers


def test_a_part_may_end_anywhere(spark):
    cut_everywhere(spark, [TEXT])


def test_random_texts(spark):
    pick = random.Random(3)
    fields = ["", "x", "a,b", 'q"q', "line\nbreak", '"', "\n", ",", "ü" * 9, '",\n,"', "plain words"]

    def written(value):
        return '"' + value.replace('"', '""') + '"' if pick.random() < 0.3 or set(value) & set('",\n') else value

    texts = []
    for number in range(6):
        lines = ["k,a,b"] + [",".join([f"{number}-{i}", written(pick.choice(fields)), written(pick.choice(fields))]) for i in range(15)]
        texts.append("\n".join(lines) + pick.choice(["", "\n"]))
    cut_everywhere(spark, texts)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_files_in_parts_give_the_rows_of_whole_files(spark, tmp_path, small_parts, newline):
    path = tmp_path / "rows.csv"
    path.write_bytes(TEXT.replace("\n", newline).encode())
    small_parts(23)
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 3
    assert check(spark, str(path)).count() == 6


def test_one_file_is_many_tasks(spark, tmp_path, small_parts):
    small_parts(800)
    path = tmp_path / "rows.csv"
    path.write_text(",".join(WIDE.names) + "\n" + "".join(f'T,"title {i}\n, ""x"""' + ",," * 7 + "\n" for i in range(200)))
    read = postings.read_postings_csv(spark, str(path), whole_file_bytes=0)
    assert read.rdd.getNumPartitions() > 5
    plain = postings.read_postings_csv(spark, str(path))
    assert read.schema == plain.schema and sorted(map(str, as_tuples(read))) == sorted(map(str, as_tuples(plain)))
    assert as_tuples(read.where("job_title like 'title 7%'").orderBy("job_title").limit(1), "job_title") == [('title 7\n, "x"',)]


def test_an_open_quote_runs_to_the_end(spark, tmp_path, small_parts):
    small_parts(60)
    path = tmp_path / "rows.csv"
    path.write_text('a,b\n1,x\n2,"never\nclosed\n' + "and on\n" * 30)
    got = read_quoted_csv(spark, str(path))
    assert got.count() == 2 and got.where("a = '2'").first().b.startswith("never\nclosed\nand on")


def test_other_headers_are_refused(spark, tmp_path, small_parts):
    (tmp_path / "1.csv").write_text("job_title,job_via\na,b\n")
    (tmp_path / "2.csv").write_text("job_via,job_title\nb,a\n")
    with pytest.raises(Exception, match="header"):
        read_quoted_csv(spark, str(tmp_path)).collect()


def test_header_only_and_empty(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert read_quoted_csv(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "e.csv").write_text("")
    assert read_quoted_csv(spark, str(tmp_path / "e.csv")).count() == 0


def test_posting_files_are_bounded_and_written_without_joins(spark, monkeypatch):
    """The task that writes a file neither joins nor sorts, and there are more files for more postings; the rows stay."""
    from postprism.plans import catalog

    folder = "/root/testdata/sf0.001"
    paths, kept = [], catalog.work_folder
    monkeypatch.setattr(catalog, "work_folder", lambda session, label: paths.append(kept(session, label)) or paths[-1])
    whole = catalog._csv_in_parts(spark, folder)
    monkeypatch.setattr(catalog, "FILE_POSTINGS", 500)
    parts = catalog._csv_in_parts(spark, folder)
    one, several = (len({row[0] for row in spark.read.text(path).select("_metadata.file_name").distinct().collect()}) for path in paths)
    assert one == 1 and several > 2
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()
