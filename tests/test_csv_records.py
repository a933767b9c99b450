"""CSV files read in many splits, against Spark's whole-file reader and Python's csv."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from rostrum.sources.csv_records import INSIDE, OUTSIDE, fields_by_name, state_after

NAMES = ["url", "text", "n"]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def texts(seed, n):
    random.seed(seed)
    parts = ["word", "a,b", 'say ""', '"', "line\nbreak", "\n\n", "\r\n", " ", "é", "", '",\n"', "x" * 300, ",,"]
    return [(f"u{i}", "".join(random.choice(parts) for _ in range(random.randint(0, 8))), str(i)) for i in range(n)]


def write(path, rows, order=(0, 1, 2), end="\n", quoting=csv.QUOTE_MINIMAL, bom=False):
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as file:
        out = csv.writer(file, lineterminator=end, quoting=quoting)
        out.writerow([NAMES[i] for i in order])
        out.writerows([[r[i] for i in order] for r in rows])


def got(spark, path, names=NAMES):
    return sorted(tuple(v or "" for v in r) for r in fields_by_name(spark, str(path), names).collect())


@pytest.mark.parametrize("line, begins, ends", [
    ('a,b', OUTSIDE, OUTSIDE), ('a,"b', OUTSIDE, INSIDE), ('a,"b""', OUTSIDE, INSIDE), ('a,"b"', OUTSIDE, OUTSIDE),
    ('a,5" disk,c', OUTSIDE, OUTSIDE), ('x"', INSIDE, OUTSIDE), ('x""', INSIDE, INSIDE), ('x","y', INSIDE, INSIDE),
    ('x",y,"z"', INSIDE, OUTSIDE), ('', INSIDE, INSIDE), ('"', OUTSIDE, INSIDE), ('""', OUTSIDE, OUTSIDE),
    ('"a"b,"c', OUTSIDE, INSIDE), ('""""', OUTSIDE, OUTSIDE), ('"""', INSIDE, OUTSIDE),
])
def test_state_after_a_line(line, begins, ends):
    assert state_after(line, begins) == ends


def test_quoted_breaks_over_many_splits(spark, small_splits, tmp_path):
    folder = tmp_path / "talks"
    folder.mkdir()
    one, two, three = texts(1, 150), texts(2, 150), texts(3, 60)
    write(folder / "a.csv", one)
    write(folder / "b.csv", two, (2, 0, 1), quoting=csv.QUOTE_ALL, bom=True)
    write(folder / "c.csv", three, (1, 2, 0), end="\r\n")
    assert spark.read.option("lineSep", "\n").text(str(folder)).rdd.getNumPartitions() > 20
    assert got(spark, folder) == sorted(one + two + three)
    assert got(spark, folder, ["n"]) == sorted((r[2],) for r in one + two + three)


def test_the_whole_file_reader_gives_the_same(spark, small_splits, tmp_path):
    path = tmp_path / "one.csv"
    write(path, texts(4, 300))
    with open(path, "a") as file:
        file.write('u,5" disk,7\n\nshort\n"x"y,z,8,too,many\n"last\n\nrecord",without,end')
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path))
    assert got(spark, path) == sorted(tuple(v or "" for v in r) for r in whole.select(*NAMES).collect())


def test_a_record_longer_than_many_splits(spark, small_splits, tmp_path):
    path = tmp_path / "long.csv"
    rows = [("a", "\n".join(["quoted, line"] * 2000), "1"), ("b", "x", "2"), ("c", "\n" * 5000, "3")]
    write(path, rows)
    assert got(spark, path) == rows


def test_files_without_records_and_without_columns(spark, tmp_path):
    write(tmp_path / "none.csv", [])
    assert got(spark, tmp_path / "none.csv") == []
    (tmp_path / "empty.csv").write_text("")
    assert got(spark, tmp_path / "empty.csv") == []
    with pytest.raises(ValueError, match="lacks"):
        fields_by_name(spark, str(tmp_path / "none.csv"), ["url", "other"])


def test_many_splits_go_without_sending_their_beginnings(spark, small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr("rostrum.sources.csv_records.MOST_SENT", 3)
    rows = texts(5, 200)
    write(tmp_path / "a.csv", rows)
    assert got(spark, tmp_path / "a.csv") == sorted(rows)
