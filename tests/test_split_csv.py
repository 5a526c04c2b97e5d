"""Quoted CSV read from byte ranges: equal to a whole-file parser wherever the ranges are cut."""

import csv
import random

import pytest

from densel.session import scratch_dir
from densel.sources import io as IO


def texts(seed, n):
    r = random.Random(seed)
    parts = ["plain", "a, b", 'said "so"', "line\nbreak", "two\r\nlines", "", "é中", '"', '""', "\n", "x" * 150, "tail\n\n"]
    return ["".join(r.choices(parts, k=r.randint(1, 5))) + str(i) for i in range(n)]


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["text", "label"])
        out.writerows(rows)


@pytest.mark.parametrize("size", [37, 300, 1 << 20])
def test_equal_to_a_whole_file_parser(spark, tmp_path, size):
    want = []
    for name, n, end in (("one", 120, "\n"), ("two", 60, "\r\n"), ("empty", 0, "\n"), ("long", 3, "\n")):
        rows = [(t, "hate" if i % 2 else "no hate") for i, t in enumerate(texts(n, n))]
        if name == "long":
            rows.insert(1, ("many\nlines\n" * 200, "hate"))   # one record over many ranges
        write(tmp_path / f"{name}.csv", rows, end)
        want += [(*r, name) for r in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        df = IO.read_term_tables(spark, str(tmp_path / "*.csv"))
        got = [tuple(r) for r in df.collect()]
        tasks = df.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted(want)
    assert size > 300 or tasks > 20


def test_without_header_and_same_as_spark_reader(spark):
    path = scratch_dir(spark, "csv")
    rows = [(t, "hate") for t in texts(9, 80)] + [("", "no hate"), (None, "hate"), ("last", None)]
    IO.write_csv(spark.createDataFrame(rows, "text string, label string"), path)
    whole = spark.read.schema(IO.TERM_TABLE_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    got = IO.read_term_tables(spark, path + "/*.csv").drop("term")
    assert sorted(got.collect(), key=str) == sorted(whole.collect(), key=str)
