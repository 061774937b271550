"""Lines of files that are read in splits, against a reader by hand."""

import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import imports, summary


@pytest.mark.parametrize("size", ["16", "57b", "1m"])
def test_numbers_of_lines_in_splits(spark, tmp_path, size):
    rnd = random.Random(7)
    for name in "abc":
        parts = ["".join(rnd.choices("aé😀\r ", k=rnd.randint(0, 30))) + rnd.choice(["\n", "\r\n"]) for _ in range(60)] + [rnd.choice(["", "last é"])]
        (tmp_path / name).write_bytes("".join(parts).encode())
    (tmp_path / "empty").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {}
        for r in imports.read_lines(spark, str(tmp_path)).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.n, r.line))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name in "abc":
        lines = (tmp_path / name).read_bytes().decode().split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        assert sorted(got[name]) == [(n, x.rstrip("\r")) for n, x in enumerate(lines, 1)]
    assert "empty" not in got


def test_a_line_that_is_too_long_is_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(imports, "MOST", 20)
    (tmp_path / "x.jsonl").write_text('{"a":1}\n' + '{"b":"' + "y" * 50 + '"}\nno json\n{"c":2}\n')
    docs, bad = imports.documents(imports.read_lines(spark, str(tmp_path)))
    assert sorted(r.body for r in docs.collect()) == ['{"a":1}', '{"c":2}'] and sorted(r.n for r in bad.collect()) == [2, 3]


def test_the_first_difference_is_found_at_any_length(spark):
    rows = [("a" * n + "X" + "b" * 500, "a" * n + "Y" + "b" * 500) for n in (0, 5, 32_767, 32_768, 100_000)] + [("same", "same"), ("", "x")]
    df = spark.createDataFrame(rows, "x string, y string")
    got = [r[0] for r in df.select(summary.windowed(F.col("x"), F.col("y"), 40)).collect()]
    assert all("X" in g for g in got[:5]) and got[5:] == ["same", ""]
