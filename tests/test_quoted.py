"""Quoted text cut anywhere, against Spark's reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.sources.flows import read_flows, with_file_row
from tidewatch.sources.quoted import quoted_records

RANGES = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def ranges(spark):
    """Set the bytes of a range; put back afterwards."""
    before = {k: spark.conf.get(k) for k in (RANGES, "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}

    def put(size):
        spark.conf.set(RANGES, str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield put
    for k in (RANGES, "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def cell(rng, separator):
    kind = rng.random()
    body = "".join(rng.choice(["a", "b", "é", " ", separator, "\n", '"', "\n\n", '""', "longer text"]) for _ in range(rng.randint(0, 5)))
    if kind < 0.45:
        return '"' + body.replace('"', '""') + '"'
    plain = body.replace(separator, "").replace("\n", "").replace('"', "")
    return plain + rng.choice(["", '"', 'x"y', '""']) if kind < 0.6 and plain.strip() else plain


def text_file(path, rng, separator, rows, ends="\n", odd_header=False):
    head = separator.join(['"id"', '"two\nlines"' if odd_header else "note", "rest"])
    lines = [head] + [separator.join([str(k), cell(rng, separator), cell(rng, separator)]) for k in range(rows)]
    path.write_bytes((ends.join(lines) + rng.choice(["", ends])).encode())


def whole(spark, path, separator):
    return spark.read.option("header", True).option("sep", separator).option("escape", '"').option("multiLine", True).csv(str(path))


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("case", range(5))
def test_random_files_at_many_cuts(spark, tmp_path, ranges, case):
    rng = random.Random(case)
    separator = ",\t"[case % 2]
    path = tmp_path / ("x.csv" if separator == "," else "x.tsv")
    text_file(path, rng, separator, 25, odd_header=case == 3, ends="\r\n" if case == 4 else "\n")
    expected = rows_of(whole(spark, path, separator))
    for size in sorted(rng.sample(range(5, path.stat().st_size), 2)):
        ranges(size)
        assert rows_of(read_flows(spark, str(path))) == expected, size


def test_every_cut_of_a_small_file(spark, tmp_path, ranges):
    path = tmp_path / "x.csv"
    path.write_text('id,note\n1,"a\nb"\n2,c"d\n3,"""\n"",\n"\n4,"e"f"g\n5,"\n\n\n"\n6,x\n')
    expected = rows_of(whole(spark, path, ","))
    for size in range(2, path.stat().st_size + 1, 9):
        ranges(size)
        assert rows_of(read_flows(spark, str(path))) == expected, size


def test_many_tasks_order_and_positions(spark, tmp_path, ranges):
    for name, first in (("a", 0), ("b", 500)):
        lines = [f'{k},"cell {k}\nof two lines, ""quoted"""' for k in range(first, first + 300)]
        (tmp_path / f"{name}.csv").write_text("id,note\n" + "\n".join(lines) + "\n")
    ranges(1_000)
    df = read_flows(spark, str(tmp_path), position=True)
    assert df.rdd.getNumPartitions() > 15
    rows = with_file_row(df).withColumn("name", F.regexp_extract("_file", "([ab]).csv", 1)).collect()
    assert sorted((r["name"], r["file_row"], r["id"]) for r in rows) == sorted(
        (name, k, str(first + k)) for name, first in (("a", 0), ("b", 500)) for k in range(300))
    assert all(r["note"] == f'cell {r["id"]}\nof two lines, "quoted"' for r in rows)


def test_files_without_line_breaks_in_cells_are_read_by_lines(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,note\n1,"a, b"\n2,c"d\n\n3,"say ""x"""\n')
    assert quoted_records(spark, str(path), ",") is None
    assert rows_of(read_flows(spark, str(path))) == rows_of(whole(spark, path, ","))


def test_a_record_over_many_ranges_and_an_open_end(spark, tmp_path, ranges):
    path = tmp_path / "x.csv"
    path.write_text('id,note\n1,"' + "line\n" * 2_000 + '"\n2,"open\nend\n')
    ranges(500)
    got = {r["id"]: r["note"] for r in read_flows(spark, str(path)).collect()}
    assert got["1"] == "line\n" * 2_000 and set(got) == {"1", "2"}
    path.write_text('id,note\n1,"a\nb",c,d\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_flows(spark, str(path), strict=True).collect()


def test_a_folder_of_many_files_takes_a_constant_number_of_jobs(spark, tmp_path):
    heads = ["id,bytes", "packets,id,note", "id,note,bytes"]
    for name, count in (("few", 30), ("many", 300)):
        (tmp_path / name).mkdir()
        for k in range(count):
            row = {"id": str(k), "bytes": str(10 * k), "packets": "1", "note": f'"n, {k}"' if k % 50 else '"two\nlines"'}
            head = heads[k % 3]
            ending = ("csv", "CSV")[k % 2]
            (tmp_path / name / f"f{k}.{ending}").write_text(f"{head}\n" + ",".join(row[c] for c in head.split(",")) + "\n")
    jobs = []
    for name, count in (("few", 30), ("many", 300)):
        group = f"folder-{name}"
        spark.sparkContext.setJobGroup(group, group)
        rows = read_flows(spark, str(tmp_path / name)).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        got = sorted((int(r["id"]), r["bytes"], r["packets"], r["note"]) for r in rows)
        assert got == [(k, None if k % 3 == 1 else str(10 * k), "1" if k % 3 == 1 else None,
                        None if k % 3 == 0 else f"n, {k}" if k % 50 else "two\nlines") for k in range(count)]
    spark.sparkContext.setJobGroup("after", "after")
    assert jobs[1] <= jobs[0] + 1 and jobs[1] < 40, jobs


def test_headers_with_line_breaks_in_a_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"no\nte"\n1,x\n')
    (tmp_path / "b.csv").write_text("\n\nid,bytes\n2,5\n")
    rows = read_flows(spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["bytes"]) for r in rows) == [("1", None), ("2", "5")]
