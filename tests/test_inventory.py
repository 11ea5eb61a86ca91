"""Every file of a folder, whatever is wrong with it."""

import os

from pyspark.sql import functions as F

from tracemesh import sources


def test_empty_unreadable_and_binary_files(spark, tmp_path):
    deep = tmp_path / "a" / "b" / "c"
    deep.mkdir(parents=True)
    (tmp_path / "empty.log").touch()
    (tmp_path / "top.log").write_bytes(b"one\ntwo\nthree")
    (deep / "long.log").write_bytes(b"x" * 40 + b"\n" + b"line\n" * 900)
    (deep / "binary.log").write_bytes(bytes(range(256)) * 10)
    (deep / "empty.log").touch()
    (deep / "gone.log").write_bytes(b"0123456789\n" * 100)
    (tmp_path / "a" / "shrunk.log").write_bytes(b"0123456789\n" * 50)
    (tmp_path / "_hidden").write_text("x\n")
    (tmp_path / "a" / ".hidden").write_text("x\n")
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        whole = sources.file_inventory(spark, folder, block=100)
        found = {r.location.removeprefix(f"file://{tmp_path}/"): (r["size"], r.events, r.error) for r in whole.collect()}
        assert found == {
            "empty.log": (0, 0, None), "top.log": (13, 3, None), "a/b/c/long.log": (4541, 901, None), "a/b/c/binary.log": (2560, 11, None),
            "a/b/c/empty.log": (0, 0, None), "a/b/c/gone.log": (1100, 100, None), "a/shrunk.log": (550, 50, None),
        }
    whole = sources.file_inventory(spark, str(tmp_path), block=100)  # listed now
    os.remove(deep / "gone.log")
    (tmp_path / "a" / "shrunk.log").write_bytes(b"1\n")
    found = {r.location.split("/")[-1]: r for r in whole.filter(F.col("size") > 0).collect()}
    assert found["gone.log"].events == 11 and "gone.log" in found["gone.log"].error
    assert found["shrunk.log"].events == 5 and found["shrunk.log"].error == "the file is shorter than it was"
    assert found["long.log"].events == 901 and found["long.log"].error is None


def test_empty_folder(spark, tmp_path):
    (tmp_path / "nothing").mkdir()
    assert sources.file_inventory(spark, str(tmp_path)).count() == 0
