"""Searches by a kept index against the scan."""

import random
import re

import pytest
from conftest import rows

from tracemesh.operators import people, search, search_index

YEAR = 2024
TERMS = ["u1", "host-1", "10.0.1.", "äÖü", "", "absent", '10.0. "05:"', '"2024-01-0"', "click", 'lic "2024"', "aaaa"]


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(4)
    lines = []
    for line in range(160):
        stamp = f"2024-01-{1 + line % 9:02d} 0{line % 10}:00:00"
        user = rng.randrange(30)
        lines += [(line, 0, stamp, "Username", rng.choice([f"u{user}", f"U{user}", "äöü", "aaaaa", "aa"]))]
        lines += [(line, 1, stamp, "IP", f"10.0.{user}.{rng.randrange(3)}")] * rng.randrange(3)
        lines += [(line, 3, stamp, "Event", rng.choice(["click", "CLICK", "view", ""]))]
        lines += [(line, 4, stamp, "Hostname", f"host-{user % 7}")] * (line % 2)
    entries = spark.createDataFrame(lines, "line bigint, pos bigint, timestamp string, type string, value string")
    routed = people.route_entries(entries, exclude=["host-3"]).cache()
    return routed, people.node_stats(routed, YEAR).cache(), people.person_groups(people.line_links(routed))


@pytest.fixture(scope="module")
def index(spark, given, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index") / "kept")
    with pytest.MonkeyPatch.context() as few:
        few.setattr(search_index, "BUCKETS", 16)
        few.setattr(search_index, "PARTS", 4)
        few.setattr(search_index, "WRITERS", 2)
        search_index.build_index(*given, folder)
        yield search_index.open_index(spark, folder)


@pytest.mark.parametrize("term", TERMS)
def test_equals_scan(given, index, term):
    found = index.search(term)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in search.search(*given, term).collect()]


def test_reads_the_parts_of_the_term_only(index):
    plan = index.candidates("host-1")._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)", plan)
    read = {int(x) for f in filters for x in re.findall(r"bucket#\d+ = (\d+)", f)}
    assert filters and all("bucket" in f for f in filters)
    buckets = {search_index._gram_bucket(g) for g in search_index.grams_of("host-1")}
    assert read and read <= buckets and len(buckets) <= 4 < search_index.BUCKETS


def test_candidates_hold_all_matches(spark, index, given):
    for text in ("host-1", "10.0.1.", "äöü", "aaaa", "lick"):
        want = given[0].filter(f"contains(lower(value), '{text}')").selectExpr("xxhash64(lower(value))").distinct()
        assert set(rows(want)) <= {(r.value_id,) for r in index.candidates(text).collect()}


def test_an_index_is_not_overwritten(given, index):
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        search_index.build_index(*given, index.folder)


def test_terms():
    read = lambda t: (lambda x: (x.text, x.time))(search.Term.read(t))
    assert read("Abc") == ("abc", None) and read('"12:0"') == (None, "12:0") and read('Ab "12"') == ("ab", "12")
    assert read('a "bc "d"') == ("a", "b") and read('"a "b"') == (None, 'a "b') and read('"') == (None, "") and read('a ""') == ("a", "")
    assert read('"x') == ('"x', None) and read('a"b"') == ('a"b"', None) and read("") == ("", None)
