"""Files on disk after a job, none after a failed one."""

import pytest
from pyspark.sql import functions as F

from lanthorn.sources import files, sink

FILES = "name string, content binary"


@pytest.fixture(scope="module")
def registered(spark):
    spark.dataSource.register(sink.FileSink)
    return spark


def there(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir() if p.name != sink.DONE}


def put(df, folder, mode="append"):
    df.write.format("whole_files").mode(mode).save(f"file://{folder}")


def test_files_on_disk(registered, tmp_path):
    rows = [(f"f{i}.txt", f"text {i}".encode()) for i in range(40)] + [("../up/x.txt", b"1"), ("C:\\dir\\x.txt", b"2"), (None, b"3"), ("", None), (".hidden", b"4"), ("_SUCCESS", b"5")]
    put(registered.createDataFrame(rows, FILES).repartition(4).withColumn("more", F.lit(1)), tmp_path / "out")
    got = there(tmp_path / "out")
    assert {k: v for k, v in got.items() if k[0] == "f" and k[1].isdigit()} == dict(rows[:40])
    assert sorted(v for k, v in got.items() if not k[1:2].isdigit()) == [b"", b"1", b"2", b"3", b"4", b"5"]
    assert {"x.txt", "x (2).txt", "file", "file (2)", "file.hidden", "file_SUCCESS"} <= set(got)
    assert not (tmp_path / "up").exists() and (tmp_path / "out" / sink.DONE).exists()
    put(registered.createDataFrame([("f1.txt", b"again")], FILES), tmp_path / "out")
    assert there(tmp_path / "out")["f1 (2).txt"] == b"again" and len(there(tmp_path / "out")) == 47
    put(registered.createDataFrame([("f1.txt", b"alone")], FILES), tmp_path / "out", "overwrite")
    assert there(tmp_path / "out") == {"f1.txt": b"alone"}


def test_nothing_after_a_failed_task(registered, tmp_path):
    folder = tmp_path / "out"
    put(registered.createDataFrame([("old.txt", b"old")], FILES), folder)
    failing = registered.range(0, 100, 1, 4).select(F.concat(F.col("id"), F.lit(".txt")).alias("name"), F.when(F.col("id") == 90, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.encode(F.lit("x"), "utf-8")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        put(failing, folder)
    assert there(folder) == {"old.txt": b"old"}


def test_cleaned_files_are_written(registered, tmp_path):
    source = registered.createDataFrame([("a.txt", "text", bytearray(b"raw"), "said [NAME]", {})], "name string, kind string, content binary, text string, value_map map<string,string>")
    put(files.cleaned_files(source), tmp_path / "out")
    assert there(tmp_path / "out") == {"a — sanitized.txt": b"said [NAME]"}


def test_what_a_sink_needs(registered, tmp_path):
    with pytest.raises(Exception, match="content"):
        put(registered.createDataFrame([("a",)], "name string"), tmp_path / "out")
