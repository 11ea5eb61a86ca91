"""Sessions, activity, search, templates and provenance."""

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_linking import ENTRY

from tracemesh.operators import activity, entries, people, provenance, search, sessions, stats, templates


def brute_sessions(times, gap_us):
    out, start, last = {}, None, None
    for t in sorted(times):
        if last is None or (t - last) // 1000 > gap_us // 1000:
            start = t
        out[t], last = start, t
    return out


@pytest.mark.parametrize("gap_ms,spread", [(1000, 40_000_000), (20, 9_000_000_000)])
def test_gap_sessions(spark, gap_ms, spread):
    rng = random.Random(gap_ms)
    data = [(k, i, rng.randrange(spread)) for k in ("a", "b") for i in range(300)]
    data += [("c", 0, 5_000_000), ("c", 1, 5_000_000 + gap_ms * 1000 + 999), ("c", 2, 5_000_000 + 2 * gap_ms * 1000 + 1999)]
    df = spark.createDataFrame(data, "k string, row_number int, us bigint").withColumn("ts", F.timestamp_micros("us"))
    df = df.repartition(5)
    got = sessions.gap_sessions(df, gap_ms, keys=["k"]).select("k", "us", F.unix_micros("session")).distinct()
    expected = set()
    for k in "abc":
        expected |= {(k, t, s) for t, s in brute_sessions([us for kk, _, us in data if kk == k], gap_ms * 1000).items()}
    assert {tuple(r) for r in got.collect()} == expected
    merged = {(r.us, r.s) for r in sessions.gap_sessions(df, gap_ms).select("us", F.unix_micros("session").alias("s")).collect()}
    assert merged == set(brute_sessions([us for _, _, us in data], gap_ms * 1000).items())


def test_session_identities(spark):
    at = datetime(2024, 1, 1)
    data = [(3, at, "IP", "x"), (1, at, "IP", "y"), (2, at + timedelta(seconds=1), "User", "u"), (4, at + timedelta(seconds=9), "IP", "z")]
    df = spark.createDataFrame(data, "row_number int, ts timestamp, type string, value string")
    tagged = sessions.gap_sessions(df)
    assert rows(sessions.session_collect(tagged).select(F.second("session"), "type", "value")) == [(0, "IP", "x"), (0, "User", "u"), (9, "IP", "z")]
    assert rows(sessions.session_summary(tagged).select("rows", F.second("end"))) == [(1, 9), (3, 1)]
    assert rows(sessions.session_rows(tagged).select(F.second("session"), "row_number")) == [(0, 1), (0, 2), (0, 3), (9, 4)]


def group_rows(seed, span_s, n):
    rng = random.Random(seed)
    start = datetime(2024, 3, 1, 10)
    return [
        (1, i, 0, (start + timedelta(seconds=rng.randint(0, span_s))).strftime("%Y-%m-%d %H:%M:%S"), "IP", f"v{rng.randint(1, 9)}", f"IPv4_v{i % 3}")
        for i in range(n)
    ]


@pytest.mark.parametrize("span,number", [(3000, 60), (80_000, 120), (500_000, 168), (900_000, 200)])
def test_heatmap_segments(spark, span, number):
    data = group_rows(span, span, 150)
    df = spark.createDataFrame(data, "group_id int, line bigint, pos bigint, timestamp string, type string, value string, node string")
    timed = activity.timed(df, 2024)
    got = activity.heatmap_segments(timed).orderBy("segment").collect()
    times = sorted(datetime.strptime(d[3], "%Y-%m-%d %H:%M:%S") for d in data)
    step = (times[-1] - times[0]) / number
    expected = []
    for i in range(number):
        low, high = times[0] + step * i, times[0] + step * (i + 1)
        expected.append((low, high, sum(low <= t < high for t in times)))
    assert [(r.start, r.end, r.cnt) for r in got] == expected
    tops, means = activity.heatmap_statistics(timed)
    hours = defaultdict(int)
    for t in times:
        hours[t.strftime("%Y-%m-%d %H:00")] += 1
    assert sorted((r.cnt for r in tops.filter("kind = 'hour'").collect()), reverse=True) == sorted(hours.values(), reverse=True)[:3]
    mean = means.first()
    assert (mean.active_hours, mean.avg_hour) == (len(hours), round(150 / len(hours) + 1e-9, 1)) and mean.unique_entries == 3
    low, high = times[10], times[100]
    part = activity.heatmap_slice(timed, low, high)
    assert part.count() == sum(low <= t < high for t in times)


def test_heatmap_of_one_instant(spark):
    df = spark.createDataFrame([(1, 1, 0, "2024-01-01 00:00:00", "IP", "v", "n")] * 3, "group_id int, line bigint, pos bigint, timestamp string, type string, value string, node string")
    got = activity.heatmap_segments(activity.timed(df, 2024))
    assert got.count() == 60 and got.filter("cnt > 0").count() == 0


def test_time_range(spark):
    df = spark.createDataFrame([(1, 0, "2024-01-01 00:00:00", "IP", "a"), (2, 0, "Jan 02 00:00:00", "IP", "b"), (3, 0, "", "IP", "c")], ENTRY)
    assert entries.time_range(df, None, None, 2024).count() == 3
    got = entries.time_range(df, datetime(2024, 1, 1), datetime(2024, 1, 2), 2024)
    assert {r.value for r in got.collect()} == {"a", "b"}


def test_search(spark):
    data = [
        (1, 0, "2024-01-01 00:00:01", "IP", "1.1.1.1"), (1, 1, "2024-01-01 00:00:01", "Username", "Bob"), (1, 2, "2024-01-01 00:00:01", "Event", "login"),
        (2, 0, "2024-01-02 00:00:01", "Email", "bob@x.yz"), (3, 0, "2024-01-03 00:00:01", "Hostname", "solo"),
    ]
    routed = people.route_entries(spark.createDataFrame(data, ENTRY))
    node_stats = people.node_stats(routed, 2024)
    groups = people.person_groups(people.line_links(routed))

    def run(term):
        return [tuple(r) for r in search.search(routed, node_stats, groups, term).collect()]

    assert run("BOB") == [
        ("Email_bob_x_yz", "Email: bob@x.yz", "primary"), ("User_Bob", "Username: Bob", "primary"), ("ID_1", "ID_1 (part of group)", "entry"),
    ]
    assert run("login") == [
        ("ID_1", "Group: 2 entries (found in filtered entries)", "filtered"),
        ("IPv4_1_1_1_1", "IP: 1.1.1.1 (found in filtered entries)", "filtered"),
        ("User_Bob", "Username: Bob (found in filtered entries)", "filtered"),
    ]
    assert run('"2024-01-03"') == [("Hostname_solo", "Hostname: solo (Date match: 2024-01-03 00:00:01)", "entry")]
    assert run('bob "00:00:01"')[-1] == ("ID_1", "Group: ID_1 (Combined match: bob at 2024-01-01 00:00:01)", "entry")
    assert search.node_details(node_stats, "User-Bob-7").first().value == "Bob"
    assert search.line_details(people.group_entries(routed, groups), 1, 1).count() == 2


def test_stoplist_toggle(spark):
    stop = spark.createDataFrame([("a",), ("b",)], "value string")
    assert rows(search.stoplist_toggle(stop, " a ")) == [("b",)]
    assert rows(search.stoplist_toggle(stop, "c")) == [("a",), ("b",), ("c",)]
    for bad in (" ", "a\nb", "x" * 501):
        with pytest.raises(ValueError):
            search.stoplist_toggle(stop, bad)


RECORDS = [
    '{"b": 1, "A": "x", "t": "2025-01-01"}', '{"A": "x", "b": "1", "t": "1234567890"}', '{"A": "Y", "b": true, "n": {"k": [1, 2]}}', '{"A": "x", "b": 1}',
]


def test_dictionary_and_vectors(spark):
    df = spark.createDataFrame(list(enumerate(RECORDS)), "rec bigint, json string").repartition(3)
    dictionary = templates.build_dictionary(df).cache()
    tokens = {r.token_text: r.token for r in dictionary.collect()}
    expected, nxt = {}, 1000
    vectors = []
    for text in RECORDS:
        record, vec = json.loads(text), []
        for key in sorted(record, key=str.casefold):
            for item in (key, record[key]):
                if isinstance(item, str) and (item.startswith("2025") or (item.startswith("1") and len(item) == 10)):
                    vec.append(1)
                    continue
                name = json.dumps(item, separators=(",", ":")).lower()
                if name not in expected:
                    nxt += 1
                    expected[name] = nxt
                vec.append(expected[name])
        vectors.append(vec)
    assert tokens == expected
    got = templates.tokenise(df, dictionary)
    assert [r.vec for r in got.orderBy("vec_id").collect()] == vectors
    back = {(r.vec_id, r.field): (r.key, r.value) for r in templates.detokenise(got, dictionary).collect()}
    assert back[0, 2] == ('"t"', '"timestamp"') and back[2, 2] == ('"n"', '{"k":[1,2]}')
    more = spark.createDataFrame([(0, '{"new": "x"}')], "rec bigint, json string")
    grown = {r.token_text: r.token for r in templates.build_dictionary(more, existing=dictionary).collect()}
    assert grown == {**expected, '"new"': nxt + 1}
    assert rows(templates.vector_lengths(got)) == [(4, 1), (6, 3)]


def brute_rules(vectors):
    """Lowest pair at distance two, rule, drop matches, again."""
    left, found = sorted(vectors), []
    while True:
        pair = None
        for a in range(len(left)):
            for b in range(a + 1, len(left)):
                (i, v), (j, w) = left[a], left[b]
                if len(v) == len(w) and sum(x != y for x, y in zip(v, w)) == 2:
                    pair = (i, v, j, w)
                    break
            if pair:
                break
        if not pair:
            return found
        i, v, j, w = pair
        rule = [x if x == y else 0 for x, y in zip(v, w)]
        hits = [k for k, u in left if len(u) == len(v) and all(r in (0, x) for r, x in zip(rule, u))]
        found.append((i, j, rule, hits))
        left = [(k, u) for k, u in left if k not in hits]


@pytest.mark.parametrize("seed,alphabet", [(1, 3), (2, 6), (3, 12)])
def test_rules(spark, seed, alphabet):
    rng = random.Random(seed)
    vectors = [(k, [1001, rng.randint(1, alphabet), 1002, rng.randint(1, alphabet), 1003, rng.randint(1, alphabet)]) for k in range(60)]
    vectors += [(60 + k, [1001, rng.randint(1, alphabet), 1002, rng.randint(1, 3)]) for k in range(20)]
    df = spark.createDataFrame(vectors, "vec_id bigint, vec array<bigint>").repartition(4)
    expected = brute_rules(vectors)
    rules = templates.mine_rules(df)
    matched = defaultdict(list)
    for r in rules.matches.collect():
        matched[r.rule_id].append(r.vec_id)
    got = [(r.i, r.j, r.rule, sorted(matched[r.rule_id])) for r in rules.rules.orderBy("rule_id").collect()]
    # Rules are mined per length, so those of different lengths may interleave by vector number.
    assert got == sorted(expected)
    values = templates.rule_values(rules, df)
    by_id = dict(vectors)
    rebuilt = {(r.rule_id, r.side): r.vec for r in templates.retokenise(rules, values).collect()}
    for n, (i, j, _, hits) in enumerate(got, 1):
        assert rebuilt[n, 0] == by_id[i] and rebuilt[n, 1] == by_id[j]
    assert {r.rule_id: r.cnt for r in templates.rule_coverage(rules).collect()} == {n: len(g[3]) for n, g in enumerate(got, 1)}
    fits = {(v, n) for v, u in vectors for n, g in enumerate(got, 1) if len(u) == len(g[2]) and all(x in (0, y) for x, y in zip(g[2], u))}
    assert {(r.vec_id, r.rule_id) for r in templates.match_rules(df, rules.rules).collect()} == fits
    shared = defaultdict(set)
    for r in templates.shared_values(values).collect():
        shared[r.token].add((r.rule_id, r.rules))
    assert all(len(s) == next(iter(s))[1] for s in shared.values())


def one_by_one(vectors):
    """``(i, j, ids that leave)`` rule by rule."""
    open_, found = dict(vectors), []
    while True:
        pairs = ((i, j) for i in sorted(open_) for j in sorted(open_) if j > i and sum(x != y for x, y in zip(open_[i], open_[j], strict=True)) == 2)
        pair = next(pairs, None)
        if pair is None:
            return found
        i, j = pair
        v, w = open_[i], open_[j]
        hits = sorted(k for k, u in open_.items() if all(x != y or x == z for x, y, z in zip(v, w, u, strict=True)))
        found.append((i, j, hits))
        for k in hits:
            del open_[k]


@pytest.mark.parametrize("share", [1, 10**9])
def test_rules_one_by_one(spark, monkeypatch, share):
    """Many small tangles at once, told apart by three places, with and without the step for chains."""
    monkeypatch.setattr(templates, "CHAIN_SHARE", share)
    vectors, expected = [], []
    # In the later ones a third vector leaves that a lower vector could still choose.
    for seed in [*range(30), 128, 1054, 1211, 1300, 1371, 1930, 2103, 2336, 2531]:
        rng = random.Random(seed)
        k = rng.choice([2, 3, 4])
        own = list({tuple(rng.randrange(k) for _ in range(5)) for _ in range(rng.randrange(5, 22))})
        rng.shuffle(own)
        own = [(1000 * seed + n, [*v, seed, seed, seed]) for n, v in enumerate(own)]
        vectors += own
        expected += one_by_one(own)
    df = spark.createDataFrame(vectors, "vec_id bigint, vec array<bigint>").repartition(4)
    rules = templates.mine_rules(df)
    matched = defaultdict(list)
    for r in rules.matches.collect():
        matched[r.rule_id].append(r.vec_id)
    assert [(r.i, r.j, sorted(matched[r.rule_id])) for r in rules.rules.orderBy("rule_id").collect()] == expected
    if share == 1:
        return
    few = templates.mine_rules(df, max_rules=37)
    assert [(r.i, r.j) for r in few.rules.orderBy("rule_id").collect()] == [e[:2] for e in expected[:37]]
    assert sorted(r.vec_id for r in few.matches.collect()) == sorted(i for e in expected[:37] for i in e[2])


def test_rules_of_a_long_chain(spark, monkeypatch):
    """Two thousand vectors, each near the next only, take a few rounds."""
    rounds, write = [], templates.materialise
    monkeypatch.setattr(templates, "materialise", lambda df, name: (rounds.append(name), write(df, name))[1])
    vec, vectors = [0] * 6, []
    for t in range(2000):
        vectors.append((t, list(vec)))
        at = 2 * t % 6
        vec[at], vec[at + 1] = vec[at] + 1, vec[at + 1] + 1
    df = spark.createDataFrame(vectors, "vec_id bigint, vec array<bigint>").repartition(4)
    rules = templates.mine_rules(df)
    assert [(r.i, r.j) for r in rules.rules.orderBy("rule_id").collect()] == [(i, i + 1) for i in range(0, 2000, 2)]
    assert rounds.count("bucket-lowest") <= 3 and rounds.count("pointers") <= 13


@pytest.mark.parametrize("d", [1, 2, 3])
def test_hamming_links(spark, d):
    """Counts by sets of places against all pairs, copies and several lengths included."""
    rng = random.Random(d)
    vectors = [(k, [7, *(rng.randint(1, 2 + k % 3) for _ in range(rng.choice([1, 2, 4, 6])))]) for k in range(150)]
    first, copies = {}, defaultdict(int)
    for k, v in vectors:
        first.setdefault(tuple(v), k)
        copies[tuple(v)] += 1
    links = {v: sum(len(v) == len(w) and sum(x != y for x, y in zip(v, w, strict=True)) == d for w in first if len(v) == len(w)) for v in first}
    df = spark.createDataFrame(vectors, "vec_id bigint, vec array<bigint>").repartition(4)
    expected = sorted(((k, first[tuple(v)], copies[tuple(v)], links[tuple(v)]) for k, v in vectors), key=repr)
    assert rows(templates.hamming_links(df, d)) == expected


def test_hamming_partners(spark):
    rng = random.Random(9)
    vectors = [(k, [rng.randint(1, 4) for _ in range(4)]) for k in range(50)]
    distinct = {}
    for k, v in vectors:
        distinct.setdefault(tuple(v), k)
    expected = {}
    for v, i in distinct.items():
        close = [j for w, j in distinct.items() if sum(x != y for x, y in zip(v, w)) == 2]
        if close:
            expected[i] = min(close)
    df = spark.createDataFrame(vectors, "vec_id bigint, vec array<bigint>").repartition(4)
    assert {r.i: r.j for r in templates.hamming_partners(df).collect()} == expected


def test_provenance_rules(spark):
    good = {
        "entry": {"timestamp": "2024-01-01T00:00:00Z", "author": "a", "processing type": "audit"},
        "data facts": {
            "storage": {"retention": {"deadline": "2030-01-01", "removal policy": "delete"}},
            "metrics": {"size": 5, "event count": 3}, "rights": {"owner": {"contact email": "a@b.cd"}}, "PII": {"sanitation": "raw"},
        },
    }
    bad = json.loads(json.dumps(good))
    bad["entry"].update({"timestamp": "yesterday", "processing type": "magic"})
    bad["data facts"]["metrics"].update({"size": 1.5, "event count": "3"})
    bad["data facts"]["storage"]["retention"].update({"deadline": "2030-02-30", "removal policy": "keep"})
    bad["data facts"]["rights"]["owner"]["contact email"] = "nobody"
    bad["data facts"]["PII"]["sanitation"] = "clean"
    df = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps(bad)), (3, "{}"), (4, "no json")], "id int, json string")
    got = provenance.validate_records(df)
    assert {(r.id, r.path.split("/")[-1], r.rule) for r in got.collect()} == {
        (2, "timestamp", "date-time"), (2, "processing type", "enum"), (2, "deadline", "date"), (2, "removal policy", "enum"),
        (2, "size", "integer"), (2, "event count", "integer"), (2, "contact email", "email"), (2, "sanitation", "enum"), (4, "", "json"),
    }


def test_identity_summary_and_stats(spark):
    tagged = spark.createDataFrame(
        [(n, 0, "", "IP", f"v{n % 5}", 1) for n in range(7)] + [(50, 0, "", "IP", "w", 2), (60, 0, "", "IP", "x", None)], ENTRY + ", identity bigint"
    )
    got = {r.identity: tuple(r)[1:] for r in stats.identity_summary(tagged).collect()}
    assert got == {1: (7, 7, 5, "7 unique lines", "IP:v0, IP:v1, IP:v2 (+ 2 more)"), 2: (1, 1, 1, "50", "IP:w")}
    lines = spark.createDataFrame([(i, "x 10.0.0.1 y") for i in range(1, 9)], "line bigint, text string")
    found = entries.classify_lines(entries.limit_lines(lines, 4, 2))
    assert stats.run_summary(lines, found, "log", limit=4).first().asDict() == {
        "source": "log", "total_lines_processed": 5, "total_classifications": 2,
    }
    assert stats.frequency_report(tagged, k=2).collect()[0].asDict() == {"type": "IP", "value": "v0", "cnt": 2, "share": 2 / 9 * 100}


def test_gap_sessions_keep_null_keys(spark):
    rows = spark.createDataFrame([(None, 1, 0), (None, 2, 500), (None, 3, 9000), ("u", 4, 0)], "who string, n int, ms int")
    rows = rows.withColumn("ts", F.timestamp_millis("ms"))
    found = sessions.gap_sessions(rows, keys=["who"])
    assert found.columns == ["who", "n", "ms", "ts", "session"]
    assert {r.n: r.session == r.ts for r in found.collect()} == {1: True, 2: False, 3: True, 4: True}
