"""First lines and line estimates by positioned reads."""

import gzip
import random

import pytest
from conftest import rows

from tracemesh import sources
from tracemesh.sources import logs, ranges


def reader(data, read):
    def read_at(at, n):
        read.append(n)
        return data[at : at + n]

    return read_at


@pytest.mark.parametrize("data", [b"", b"\n", b"a", b"a\n", b"a\n\nb", b"x\r\ny\r\n", b"\n\n\n", b"long" * 40 + b"\nend"])
@pytest.mark.parametrize("limit", [0, 1, 2, 3, 100])
@pytest.mark.parametrize("first", [1, 7, 1 << 16])
def test_first_lines(monkeypatch, data, limit, first):
    monkeypatch.setattr(ranges, "FIRST_READ", first)
    whole = data.split(b"\n")
    whole = whole[:-1] if whole[-1] == b"" else whole
    assert list(ranges.first_lines(reader(data, []), len(data), limit)) == whole[:limit]


def test_few_bytes_are_read():
    """Ten lines of a file of a hundred blocks take one read of the smallest size."""
    data, read = b"".join(b"line %d\n" % n for n in range(1_000_000)), []
    assert len(list(ranges.first_lines(reader(data, read), len(data), 10))) == 10
    assert read == [ranges.FIRST_READ] and len(data) > 100 * sum(read)
    read.clear()
    assert len(list(ranges.first_lines(reader(data, read), len(data), 100_000))) == 100_000
    assert sum(read) < 3 * data.index(b"line 100000\n")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a b%20c.txt").write_bytes(b"".join(b"a %d%s\n" % (n, b"\r" * (n % 3 == 0)) for n in range(2500)))
    (tmp_path / "b.txt").write_bytes("eins\nzwei\r\n\nü".encode())
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"last\n" * 7)
    return tmp_path


@pytest.mark.parametrize("across", [False, True])
@pytest.mark.parametrize("limit,sample", [(5, 1), (2000, 7), (2503, 1), (10_000, 2)])
def test_limit_is_the_full_read_cut_off(spark, folder, monkeypatch, across, limit, sample):
    found = rows(sources.read_log(spark, str(folder), limit=limit, sample=sample, across_files=across))
    monkeypatch.setattr(logs, "FEW_LINES", 0)
    assert found == rows(sources.read_log(spark, str(folder), limit=limit, sample=sample, across_files=across))
    assert found


def test_compressed_files_are_read_whole(spark, tmp_path):
    with gzip.open(tmp_path / "z.txt.gz", "wb") as file:
        file.write(b"one\ntwo\nthree\n")
    assert [(r.line, r.text) for r in sources.read_log(spark, str(tmp_path), limit=2).collect()] == [(1, "one"), (2, "two")]
    (found,) = sources.line_estimates(spark, str(tmp_path)).collect()
    assert (found.lines, found.error) == (3.0, 0.0)
    assert sources.estimate_lines(spark, str(tmp_path)) == 3


def test_estimates(spark, folder):
    """Within three standard errors on lines of mixed lengths, from a tenth of the bytes, exact when all is read or files are small."""
    rng = random.Random(1)
    long = b"".join(b"x" * rng.choice([0, 5, 30, 400 if n < 40_000 else 40]) + b"\n" for n in range(120_000))
    (folder / "long.txt").write_bytes(long)
    exact = {"a b%20c.txt": 2500, "b.txt": 4, "c.txt": 0, "d.txt": 7, "long.txt": 120_000}
    name = lambda r: r.path.split("/")[-1].replace("%20", " ").replace("%25", "%").replace("a b c", "a b%20c")
    by_name = lambda df: {name(r): r for r in df.collect()}
    few = by_name(sources.line_estimates(spark, str(folder), exact_below=100_000, share=0.1, block=4096))
    assert {n: r.lines for n, r in few.items() if n != "long.txt"}.items() <= exact.items()
    assert all(r.error == 0 for n, r in few.items() if n != "long.txt")
    guess = few["long.txt"]
    assert 0 < guess.error < 4000 and abs(guess.lines - 120_000) <= 3 * guess.error and guess.bytes_read < 0.15 * len(long)
    for settings in ({}, {"exact_below": 0, "share": 1.0, "block": 4096}):
        every = by_name(sources.line_estimates(spark, str(folder), **settings))
        assert {n: r.lines for n, r in every.items()}.items() <= exact.items() and all(r.error == 0 for r in every.values())
    assert sources.estimate_lines(spark, str(folder)) == 122_511
