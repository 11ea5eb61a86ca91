"""Tables kept between sessions, and what is kept in them."""

import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import rows

from tracemesh.operators import kept as K
from tracemesh.operators import templates
from tracemesh.sources.kept import KeptTables, VersionConflict


@pytest.fixture
def kept(spark, tmp_path):
    return KeptTables(spark, str(tmp_path / "kept"))


def stop_values(snapshot):
    return sorted(r.value for r in snapshot.read("stoplist").collect())


def test_versions_stay_readable(spark, kept):
    assert kept.versions() == [] and kept.snapshot().version == 0 and kept.snapshot().read("t") is None
    first = kept.commit(kept.snapshot(), replace={"t": spark.range(3), "u": spark.range(1)})
    second = kept.commit(first, append={"t": spark.range(3, 5)})
    third = kept.commit(second, replace={"t": spark.range(9, 10)})
    assert [rows(kept.snapshot(v).read("t")) for v in (1, 2, 3)] == [[(0,), (1,), (2,)], [(n,) for n in range(5)], [(9,)]]
    assert rows(third.read("u")) == [(0,)]
    with pytest.raises(ValueError, match="other columns"):
        kept.commit(third, append={"t": spark.range(1).selectExpr("id AS other")})
    kept.forget(before=3)
    assert kept.versions() == [3] and rows(kept.snapshot().read("t")) == [(9,)] and rows(kept.snapshot().read("u")) == [(0,)]
    assert len(os.listdir(kept.folder.removeprefix("file:") + "/data")) == 2


@pytest.mark.parametrize("by_rename", [False, True])
def test_one_of_two_writers_wins(spark, kept, monkeypatch, by_rename):
    if by_rename:  # the way of HDFS, on local files
        monkeypatch.setattr(os, "link", lambda a, b: kept._rename("file:" + a, "file:" + b))
    start = kept.commit(kept.snapshot(), replace={"t": spark.range(1)})
    kept.commit(start, replace={"t": spark.range(2)})
    with pytest.raises(VersionConflict):
        kept.commit(start, replace={"t": spark.range(7)})
    assert kept.versions() == [1, 2] and kept.snapshot().read("t").count() == 2
    assert len(os.listdir(kept.folder.removeprefix("file:") + "/data")) == 2  # what the loser wrote is gone


def test_writer_that_stops_before_the_commit(spark, kept, monkeypatch):
    kept.commit(kept.snapshot(), replace={"t": spark.range(1)})

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(os, "link", killed)
    with pytest.raises(KeyboardInterrupt):
        kept.commit(kept.snapshot(), replace={"t": spark.range(5)})
    monkeypatch.undo()
    again = KeptTables(spark.newSession(), kept.folder)
    assert again.versions() == [1] and again.snapshot().read("t").count() == 1
    assert again.commit(again.snapshot(), replace={"t": spark.range(5)}).version == 2


def test_stop_list_of_two_sessions(spark, kept):
    K.toggle_stop_value(kept, " click ")
    other = KeptTables(spark.newSession(), kept.folder)
    K.toggle_stop_value(other, "login")
    assert stop_values(kept.snapshot()) == ["click", "login"]
    assert stop_values(K.toggle_stop_value(kept, "click")) == ["login"]
    assert stop_values(kept.snapshot(1)) == ["click"]


def test_writers_at_once_lose_nothing(spark, kept):
    names = [f"v{n}" for n in range(6)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda v: K.toggle_stop_value(kept, v), names))
    assert stop_values(kept.snapshot()) == names and kept.versions() == list(range(1, 7))


def test_dictionary_keeps_its_tokens(spark, kept):
    records = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "rec bigint, json string")
    first = records('{"a": "x", "b": 1}', '{"a": "y"}')
    second = records('{"c": "x", "a": "z"}')
    K.grow_dictionary(kept, first)
    grown = K.grow_dictionary(KeptTables(spark.newSession(), kept.folder), second).read("dictionary")
    want = templates.build_dictionary(second, existing=templates.build_dictionary(first))
    assert rows(grown) == rows(want)
    old = {r.token_text: r.token for r in kept.snapshot(1).read("dictionary").collect()}
    new = {r.token_text: r.token for r in grown.collect()}
    assert old.items() <= new.items() and len(set(new.values())) == len(new) > len(old)


def plain_identities(pairs):
    """First line of each line's component, by merging sets."""
    start = {line: line for line, _, _ in pairs}

    def find(x):
        while start[x] != x:
            x = start[x]
        return x

    first = {}
    for line, kind, value in sorted(pairs, key=lambda p: p[0]):
        if value is not None:
            a, b = sorted((find(line), find(first.setdefault((kind, value), line))))
            start[b] = a
    return {line: find(line) for line in start}


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_give_the_identities_of_one_run(spark, kept, seed):
    rng = random.Random(seed)
    pairs = [(line, rng.choice("ab"), str(rng.randrange(60)) if rng.random() < 0.9 else None) for line in range(90) for _ in range(rng.choice([1, 1, 2]))]
    rng.shuffle(pairs)  # lines come in any order, and some come twice
    seen = []
    for n in range(5):
        delta = pairs[n * len(pairs) // 5 : (n + 1) * len(pairs) // 5]
        seen += delta
        now = K.add_lines(kept, spark.createDataFrame(delta, "line bigint, type string, value string"))
        assert {r.line: r.start for r in K.kept_identities(now).collect()} == plain_identities(seen)
    same = K.add_lines(kept, spark.createDataFrame(pairs[:20], "line bigint, type string, value string"))
    assert rows(K.kept_identities(same)) == rows(K.kept_identities(now))
    assert rows(K.kept_identities(kept.snapshot(2))) == sorted(plain_identities(pairs[: 2 * len(pairs) // 5]).items(), key=repr)


def test_empty_delta(spark, kept):
    now = K.add_lines(kept, spark.createDataFrame([], "line bigint, type string, value string"))
    assert K.kept_identities(now).count() == 0
