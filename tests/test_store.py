"""The file sink: all files or none."""

import pytest
from pyspark.sql import functions as F

from pixelmill.sources import store

SCHEMA = "name string, content binary"


def tree(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_commits_files_and_runs_again(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i}.bin", bytearray([i] * (i + 1))) for i in range(40)]
    files = spark.createDataFrame(rows, SCHEMA).repartition(4)
    folder = tmp_path / "out"
    store.write_files(files, str(folder))
    first = tree(folder)
    assert first == {n: bytes(c) for n, c in rows}
    store.write_files(files, f"file://{folder}", overwrite=True)
    assert tree(folder) == first
    with pytest.raises(Exception, match="there already"):
        store.write_files(files, str(folder))
    assert tree(folder) == first
    assert {(r["name"], r["size"]) for r in store.files_in(spark, str(folder)).select("name", "size").collect()} == {(n, len(c)) for n, c in rows}


def test_runs_of_rows_are_one_file(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"12")), ("a", None), ("a", bytearray(b"3")), ("b", bytearray(b""))], SCHEMA).coalesce(1)
    store.write_files(files, str(tmp_path))
    assert tree(tmp_path) == {"a": b"123", "b": b""}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "f1").write_bytes(b"old")
    content = F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.encode(F.col("id").cast("string"), "utf-8"))
    files = spark.range(100).repartition(4).select(F.concat(F.lit("f"), "id").alias("name"), content.alias("content"))
    with pytest.raises(Exception, match="lost"):
        store.write_files(files, str(tmp_path), overwrite=True)
    assert tree(tmp_path) == {"f1": b"old"} and len(list(tmp_path.iterdir())) == 1


@pytest.mark.parametrize("names", [["same", "same"], ["../up"], ["/root"], [None], [""]])
def test_bad_names(spark, tmp_path, names):
    files = spark.createDataFrame([(n, bytearray(b"x")) for n in names], SCHEMA).repartition(2)
    if names[0] == "same":
        files = files.unionByName(spark.createDataFrame([("between", bytearray(b"y")), ("same", bytearray(b"z"))], SCHEMA))
    with pytest.raises(Exception, match="one name|not a file name"):
        store.write_files(files, str(tmp_path))
    assert tree(tmp_path) == {}


def test_commit_puts_back_what_it_moved(tmp_path):
    (tmp_path / "a").write_bytes(b"old a")
    writer = store.FileWriter(str(tmp_path), True)
    stage = tmp_path / writer.job
    stage.mkdir()
    (stage / "0").write_bytes(b"new a")
    with pytest.raises(OSError):
        writer.commit([store.Staged([("a", f"{stage}/0"), ("b", f"{stage}/not there")])])
    writer.abort([])
    assert tree(tmp_path) == {"a": b"old a"}


def test_empty(spark, tmp_path):
    store.write_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "new"))
    assert tree(tmp_path) == {}
