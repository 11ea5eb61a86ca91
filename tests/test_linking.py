"""Identities, groups, logs and covers against plain-Python restatements on small random inputs."""

import heapq
import logging
import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracemesh.operators import cover, formation, identities, order, people
from tracemesh.operators.forest import spanning_forest
from tracemesh.session import materialise, shared_folder

ENTRY = "line bigint, pos bigint, timestamp string, type string, value string"


def random_entries(seed, lines, values, width, types=("IP", "Username")):
    rng = random.Random(seed)
    out = []
    for line in range(1, lines + 1):
        for pos in range(rng.randint(1, width)):
            out.append((line, pos, f"2024-01-01 00:{line // 60 % 60:02d}:{line % 60:02d}", rng.choice(types), f"v{rng.randint(1, values)}"))
    return out


def greedy(entries, low, cap):
    """The ordered one-pass rule."""
    freq = defaultdict(int)
    for line, pos, _, t, v in entries:
        freq[t, v] += 1
    of_value, of_line, n = {}, {}, 0
    for line, pos, _, t, v in entries:
        if not low <= freq[t, v] <= cap:
            continue
        if (t, v) in of_value:
            of_line[line] = of_value[t, v]
        elif line in of_line:
            of_value[t, v] = of_line[line]
        else:
            of_value[t, v] = of_line[line] = n
            n += 1
    rank = {i: k + 1 for k, i in enumerate(sorted(set(of_line.values())))}
    return {line: rank[i] for line, i in of_line.items()}


def union_find(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_identities(spark, seed):
    entries = random_entries(seed, 60, 60, 4)
    for shards in (1, 7):
        df = spark.createDataFrame(entries, ENTRY).repartition(shards)
        got = identities.identities(df, max_freq=10.0)
        assert got.count() == len(entries)
        by_line = {r.line: r.identity for r in got.collect() if r.identity is not None}
        assert by_line == greedy(entries, 2, 6)


def test_component_identities(spark):
    entries = random_entries(3, 60, 90, 3)
    got = identities.identities(spark.createDataFrame(entries, ENTRY).repartition(5), max_freq=50.0, mode="components")
    by_line = {r.line: r.identity for r in got.collect()}
    freq, lines_of = defaultdict(int), defaultdict(set)
    for line, _, _, t, v in entries:
        freq[t, v] += 1
        lines_of[t, v].add(line)
    pairs = [(min(s), x) for k, s in lines_of.items() if 2 <= freq[k] <= 30 for x in s]
    roots = union_find({e[0] for e in entries}, pairs)
    first = {}
    for line in sorted(roots):
        first.setdefault(roots[line], len(first) + 1)
    assert by_line == {line: first[r] for line, r in roots.items()}


def test_search_and_trace(spark):
    entries = [
        (1, 0, "", "IP", "a"), (1, 1, "", "IP", "b"), (2, 0, "", "IP", "a"), (3, 0, "", "IP", "c"), (4, 0, "", "IP", "c"), (5, 0, "", "IP", "z"),
    ]
    tagged = identities.identities(spark.createDataFrame(entries, ENTRY), max_freq=100.0).cache()
    assert {(r.line, r.value, r.identity) for r in identities.search_identity(tagged, "IP:b").collect()} == {
        (1, "a", "Identity_1"), (1, "b", "Identity_1"), (2, "a", "Identity_1"),
    }
    assert {r.line for r in identities.trace_identity(tagged, 2).collect()} == {3, 4}
    outcomes = [identities.search_outcome(tagged, v, cap=1).first().outcome for v in ("a", "q", "z", "b")]
    assert outcomes == ["too frequent", "not found", "no identity", "found"]
    assert identities.search_identity(tagged, "a", cap=1).count() == 0


def test_previous_value_across_slices(spark):
    data = [(g, p, f"{g}.{p}") for g in range(4) for p in range(0, 40 if g else 3)]
    df = spark.createDataFrame(data, "g int, p bigint, v string").repartition(5)
    got = {(r.g, r.p): r.prev for r in order.previous_value(df, "g", "p", F.col("v"), "prev", size=7).collect()}
    assert got == {(g, p): f"{g}.{p - 1}" if p else None for g, p, _ in data}


def test_number_rows(spark):
    data = [(k, v) for k in range(3) for v in range(200 if k else 5)]
    df = spark.createDataFrame(data, "k int, v int").repartition(6)
    total = {(r.k, r.v): r.n for r in order.number_rows(df, ["k", "v"], "n").collect()}
    assert total == {kv: i + 1 for i, kv in enumerate(sorted(data))}
    inside = {(r.k, r.v): r.n for r in order.number_rows(df, ["v"], "n", within=["k"]).collect()}
    assert inside == {(k, v): v + 1 for k, v in data}


def replay(entries):
    """Every pair of a line in order; the log of changes, and the last change of each group."""
    lines = defaultdict(list)
    for line, pos, _, t, v in entries:
        lines[line].append((pos, f"{t}:{v}"))
    pairs, seen = [], set()
    for line in sorted(lines):
        items = sorted(lines[line])
        for i in range(len(items)):
            for j in range(i + 1, len(items)):
                pair = (items[i][1], items[j][1])
                if pair not in seen:
                    seen.add(pair)
                    pairs.append((line, items[i][0], items[j][0], *pair))
    group, last, members, log, edges = {}, {}, {}, [], []
    for line, pa, pb, a, b in pairs:
        ga, gb = group.get(a), group.get(b)
        if ga is not None and ga is gb:
            continue
        step = (line, pa, pb)
        kind = "FORMED" if ga is None and gb is None else "MERGED" if ga is not None and gb is not None else "ADDED"
        new = {a, b} | (ga or set()) | (gb or set())
        for g in (ga, gb):
            if g is not None:
                edges.append((last[id(g)], step))
        members[step] = frozenset(new)
        for n in new:
            group[n] = new
        last[id(new)] = step
        log.append((step, kind, frozenset((a, b))))
    keep = {id(g): g for g in group.values()}
    return list(keep.values()), log, sorted(edges), members


def linked(spark, entries, shards=3):
    df = spark.createDataFrame(entries, ENTRY).repartition(shards)
    routed = people.route_entries(df).withColumn(
        "node", F.when(F.col("route") == "node", F.concat("type", F.lit(":"), "value"))
    )
    return routed, people.person_groups(people.line_links(routed))


@pytest.mark.parametrize("seed,values,width", [(5, 60, 4), (6, 25, 2), (7, 200, 3)])
def test_groups_log_and_formation(spark, seed, values, width):
    entries = random_entries(seed, 50, values, width)
    # A node twice on a line forms a group of its own; a hub joins many nodes one by one.
    entries += [(100, 0, "", "IP", "twice"), (100, 1, "", "IP", "twice"), (101, 0, "", "IP", "twice"), (101, 1, "", "IP", "late")]
    entries += [(110 + i, p, "", "IP", v) for i in range(12) for p, v in enumerate(["hub", f"leaf{i}"])]
    entries += [(130 + i, p, "", "IP", v) for i in range(9) for p, v in enumerate([f"chain{i}", f"chain{i + 1}"])]
    entries.append((200, 0, "", "IP", "alone"))
    expected_groups, log, edges, members = replay(entries)
    routed, groups = linked(spark, entries)

    by_group = defaultdict(set)
    for r in groups.members.collect():
        by_group[r.group_id].add(r.node)
    assert sorted(map(sorted, by_group.values())) == sorted(map(sorted, expected_groups))
    first = {g: min(s for s, _, pair in log if pair <= nodes) for g, nodes in by_group.items()}
    assert [g for g, _ in sorted(first.items(), key=lambda x: x[1])] == list(range(1, len(first) + 1))

    stats = people.node_stats(routed, 2024)
    got = people.merge_log(groups, stats).collect()
    assert sorted(((r.line, r.pos_a, r.pos_b), r.event, frozenset((r.src, r.dst))) for r in got) == sorted(log, key=lambda x: x[0])
    for g in by_group:
        steps = sorted((r.step, (r.line, r.pos_a, r.pos_b)) for r in got if r.group_id == g)
        assert [s for s, _ in steps] == list(range(1, len(steps) + 1))
        assert [p for _, p in steps] == sorted(p for _, p in steps)

    steps = formation.formation_steps(groups).cache()
    place = {r.seq: (r.line, r.pos_a, r.pos_b) for r in steps.collect()}
    found = sorted((place[r.seq], place[r.parent]) for r in steps.collect() if r.parent is not None)
    assert found == edges
    middle = sorted(place)[len(place) // 2]
    got_members = {r.node for r in formation.step_members(groups, steps, middle).collect()}
    assert got_members == set(members[place[middle]])

    alone = {r.node: r.group_id for r in people.singleton_groups(routed, groups).collect()}
    lonely = sorted({f"{t}:{v}" for _, _, _, t, v in entries} - set().union(*by_group.values()))
    assert alone == {n: len(by_group) + i + 1 for i, n in enumerate(lonely)}


def test_forest_of_a_long_path(spark):
    edges = [(i, i + 1, i) for i in range(60)] + [(100, 100, 1)]
    forest = spanning_forest(spark.createDataFrame(edges, "src bigint, dst bigint, w bigint"), ["w"])
    labels = {r.node: r.root for r in forest.labels.collect()}
    assert len({labels[i] for i in range(61)}) == 1 and labels[100] == 100
    assert forest.edges.count() == 60


def brute_cover(entries):
    lines = defaultdict(set)
    for line, _, _, _, v in sorted(entries):
        lines[line].add(v)
    everything, covered, picked = set().union(*lines.values()), set(), []
    while covered != everything:
        best = max(sorted(lines), key=lambda x: len(lines[x] - covered))
        picked.append(best)
        covered |= lines[best]
    return set(picked)


def test_line_cover(spark):
    data, expected = [], set()
    for g in range(4):
        entries = random_entries(20 + g, 30, 25, 5)
        data += [(g, *e) for e in entries]
        expected |= {(g, line) for line in brute_cover(entries)}
    df = spark.createDataFrame(data, "group_id int, " + ENTRY).repartition(4)
    got = cover.line_cover(df)
    assert {(r.group_id, r.line) for r in got.collect()} == expected
    values = cover.cover_values(df, got)
    assert {(r.group_id, r.line, r.value) for r in values.collect()} == {
        (g, line, v) for g, line, _, _, _, v in data if (g, line) in expected
    }


def test_line_cover_of_a_chain(spark, monkeypatch):
    """Each line shares a value with the next; the rounds must not grow with the number of lines."""
    entries = [(line, pos, "t", "IP", f"v{line + pos}") for line in range(200) for pos in range(2)]
    data = [(0, *e) for e in entries] + [(None, 1, 0, "t", "IP", "x"), (1, 1, 0, "t", "IP", None)]
    written = []
    real = cover.materialise
    monkeypatch.setattr(cover, "materialise", lambda df, name: written.append(name) or real(df, name))
    got = cover.line_cover(spark.createDataFrame(data, "group_id int, " + ENTRY))
    assert {r.line for r in got.collect()} == brute_cover(entries)
    assert written.count("cover") <= 4 and len(written) < 30


def heap_cover(lines):
    """The one-by-one rule on ``{line: values}``, with a heap of gains that are looked at again when they come up."""
    users = defaultdict(list)
    for line, values in lines.items():
        for v in values:
            users[v].append(line)
    gain = {line: len(values) for line, values in lines.items()}
    heap = [(-n, line) for line, n in gain.items()]
    heapq.heapify(heap)
    covered, picked = set(), set()
    while heap:
        n, line = heapq.heappop(heap)
        if -n != gain[line]:
            if gain[line]:
                heapq.heappush(heap, (-gain[line], line))
        elif n:
            picked.add(line)
            for v in lines[line] - covered:
                covered.add(v)
                for other in users[v]:
                    gain[other] -= 1
    return picked


def test_line_cover_of_tangled_lines(spark, caplog):
    """10,000 lines in five groups, most values on several lines: few rounds, and the lines of the one-by-one rule."""
    rng, data, expected = random.Random(3), [], set()
    for g, (values, hot) in enumerate([(500, 0), (3000, 0), (20000, 0), (3000, 1), (100000, 1)]):
        lines = {k: {rng.randrange(values) for _ in range(rng.randint(1, 12))} | ({-1} if hot and k % 3 == 0 else set()) for k in range(2000)}
        data += [(g, k, f"v{v}") for k, found in lines.items() for v in found]
        expected |= {(g, k) for k in heap_cover(lines)}
    with caplog.at_level(logging.INFO, logger=cover.__name__):
        got = cover.line_cover(spark.createDataFrame(data, "group_id int, line bigint, value string"))
    assert {(r.group_id, r.line) for r in got.collect()} == expected
    assert int(caplog.records[-1].message.split()[1]) <= 20


def test_line_cover_of_many_small_tangles(spark):
    """Chains, rings and stars with equal and unequal lines, where a line may wait for lines with as many values or more."""
    rng, data, expected = random.Random(4), [], set()
    for g in range(400):
        size = rng.randint(2, 9)
        lines = {k: {rng.randrange(size + 2) for _ in range(rng.randint(1, 4))} for k in range(size)}
        if g % 2:
            order = rng.sample(range(size), size)
            lines = {k: {("s", at), ("s", at + 1)} | {(k, x) for x in range(rng.randint(0, 1 + g % 3))} for at, k in enumerate(order)}
        data += [(g, k, str(v)) for k, found in lines.items() for v in found]
        expected |= {(g, k) for k in heap_cover(lines)}
    got = cover.line_cover(spark.createDataFrame(data, "group_id int, line bigint, value string"))
    assert {(r.group_id, r.line) for r in got.collect()} == expected


@pytest.mark.parametrize("limit", [order.LOOKUP_BYTES, 0])
def test_lookup_join(spark, monkeypatch, limit):
    """Broadcast or dealt to copies, the rows are the same; one key has most of them."""
    monkeypatch.setattr(order, "LOOKUP_BYTES", limit)
    left = spark.createDataFrame([(i, "hot" if i % 4 else f"k{i}" if i % 8 else None) for i in range(200)], "i int, k string")
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("k4", 3), (None, 4), ("other", 5)], "k string, v int")
    found = {"hot": [1, 2], "k4": [3]}
    inner = [(k, i, v) for i, k in left.collect() for v in found.get(k, [])]
    assert rows(order.join_lookup(left, table, "k", ["i"]).select("k", "i", "v")) == sorted(inner, key=repr)
    outer = [(k, i, v) for i, k in left.collect() for v in found.get(k, [None])]
    assert rows(order.join_lookup(left, table, "k", ["i"], "left").select("k", "i", "v")) == sorted(outer, key=repr)


def test_tuple_provenance(spark):
    entries = [
        (1, 1, 0, "t1", "IP", "a"), (1, 1, 1, "t1", "IP", "c"), (1, 2, 0, "t2", "IP", "a"), (1, 2, 1, "t2", "URL", "http://b?x"),
        (1, 3, 0, "t3", "IP", "d"), (1, 3, 1, "t3", "IP", "a"), (1, 3, 2, "t3", "URL", "http://b?y"), (2, 1, 0, "u", "IP", "a"),
    ]
    df = spark.createDataFrame(entries, "group_id int, " + ENTRY)
    pairs = spark.createDataFrame([(1, "a", "http://b"), (1, "c", "d"), (2, "a", "zz")], "group_id int, a_value string, b_value string")
    got = rows(formation.tuple_provenance(pairs, df).select("group_id", "a_value", "side", "value", "line", "timestamp", "type", "tuple_line"))
    assert got == sorted([
        (1, "a", 0, "a", 2, "t2", "IP", 2), (1, "a", 1, "http://b", 2, "t2", "URL", 2),
        (1, "c", 0, "c", 1, "t1", "IP", None), (1, "c", 1, "d", 3, "t3", "IP", None),
        (2, "a", 0, "a", 1, "u", "IP", None), (2, "a", 1, "zz", None, "N/A", "", None),
    ], key=repr)


def test_routes_and_stats(spark):
    entries = [
        (1, 0, "2024-01-01 00:00:01", "IP", "1.1.1.1"), (1, 1, "2024-01-01 00:00:01", "Event", "login"),
        (1, 2, "2024-01-01 00:00:01", "DNSName", "h.example"), (2, 0, "2024-01-01 00:00:00", "IP", "1.1.1.1"),
        (2, 1, "x", "Event", "stop"), (2, 2, "x", "Username", "out"), (2, 3, "x", "Event", "view"), (3, 0, "", "IP", ""),
        (4, 0, "never", "Email", "q@x.yz"),
    ]
    stop = spark.createDataFrame([("stop",)], "value string")
    df = spark.createDataFrame(entries, ENTRY)
    routed = people.route_entries(df, stop, exclude=["out"])
    assert {(r.line, r.pos, r.route, r.node) for r in routed.collect()} == {
        (1, 0, "node", "IPv4_1_1_1_1"), (1, 1, "filtered", None), (1, 2, "node", "DNS_h_example"), (2, 0, "node", "IPv4_1_1_1_1"),
        (2, 1, "node", "Event_stop"), (2, 2, "filtered", None), (2, 3, "filtered", None), (4, 0, "node", "Email_q_x_yz"),
    }
    strict = people.route_entries(df, stop, exclude=["out"], normalise_types=False, unknown_types="drop")
    assert {(r.line, r.pos) for r in strict.filter("route = 'node'").collect()} == {(1, 0), (2, 0), (4, 0)}
    stats = {r.node: (r.cnt, r.first_seen, r.last_seen) for r in people.node_stats(routed, 2024).collect()}
    assert stats["IPv4_1_1_1_1"] == (2, "2024-01-01 00:00:01", "2024-01-01 00:00:00")
    assert stats["Email_q_x_yz"] == (1, "N/A", "N/A")
    assert dict(people.technical_counts(routed).collect()) == {"IPv4_1_1_1_1": 3, "DNS_h_example": 1, "Event_stop": 2}
    groups = people.person_groups(people.line_links(routed))
    assert [tuple(r) for r in people.group_stats(routed, groups, 2024).collect()] == [
        (1, 3, 4 + 6, "2024-01-01 00:00:01", "x")
    ]
    assert [tuple(r) for r in people.group_summary(routed, groups, 2024).select("group_id", "cnt", "nodes").collect()] == [(1, 10, 3)]
    assert [r.value for r in people.exclusion_catalogue(routed, stop).collect()] == ["login", "out", "stop", "view"]
    technical = people.technical_entries(routed, spark.createDataFrame([("IPv4_1_1_1_1",)], "node string"))
    assert rows(technical.select("line", "value", "times")) == [(1, "login", 1), (2, "out", 1), (2, "view", 1)]


def test_rounds_leave_only_live_tables(spark):
    def tables(name):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/tracemesh/{spark.sparkContext.applicationId}")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        return sum(f.getPath().getName().startswith(f"{name}-") for f in files)

    materialise(spark.range(1), "edges")  # the folder exists
    before = tables("edges")
    chain = spark.createDataFrame([(str(k), str(k + 1), (k * 7919) % 64) for k in range(64)], "src string, dst string, line int")
    found = spanning_forest(chain, ["line"])
    assert found.labels.select("root").distinct().count() == 1 and found.edges.count() == 64
    assert len(found.rounds) > 2
    assert tables("edges") - before == 1


def test_components(spark):
    """Chains, stars, circles, loops, repeated and mutual links, in node numbers that rise, fall or are mixed."""
    from tracemesh.operators.forest import components

    rng = random.Random(11)
    mixed = rng.sample(range(1000, 1100), 100)
    links = [(i, i + 1) for i in range(1, 60)] + [(i + 1, i) for i in range(200, 230)] + [(300, 300 + i) for i in range(1, 50)]
    links += [(499, i) for i in range(450, 499)] + [(600, 601), (601, 602), (602, 600), (601, 600), (700, 700), (701, 701), (701, 702), (701, 702)]
    links += [(mixed[i], mixed[i + 1]) for i in range(99)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(120)]
    parent = {n: n for pair in links for n in pair}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        parent[find(a)] = find(b)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    assert found.keys() == parent.keys()
    groups, roots = defaultdict(set), defaultdict(set)
    for node, root in found.items():
        groups[root].add(node)
        roots[find(node)].add(root)
    assert all(root in members for root, members in groups.items()) and all(len(r) == 1 for r in roots.values()) and len(groups) == len(roots)
    assert components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_components_compare_numbers_only(spark, sf_dir, monkeypatch):
    """No part of a round sorts to aggregate, as the smallest of edges with their weights would."""
    from tracemesh.operators import forest

    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, name)

    monkeypatch.setattr(forest, "materialise", written)
    edges = spark.range(50).selectExpr("id AS src", "id + 1 AS dst")
    labels = identities.components(edges)
    assert labels.count() == 51 and plans and not any("SortAggregate" in p for p in plans)


def test_forest_compares_numbers_only(spark, monkeypatch):
    """Rounds over named nodes hash numbers; the smallest of edges with their names would be found by sorting."""
    from tracemesh.operators import forest

    plans = []

    def written(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialise(df, name)

    monkeypatch.setattr(forest, "materialise", written)
    edges = [(f"n{k}", f"n{k + 1}", (k * 7919) % 64) for k in range(64)] + [("alone", "alone", 70), ("n3", "n9", 90)]
    found = forest.spanning_forest(spark.createDataFrame(edges, "src string, dst string, line int"), ["line"])
    rounds = [p for name, p in plans if name in ("edges", "hooks", "pointers", "labels", "forest")]
    assert len(rounds) > 5 and not any("SortAggregate" in p for p in rounds)
    assert sorted((r.src, r.dst) for r in found.edges.collect()) == sorted((a, b) for a, b, line in edges if line < 70)
    roots = {r.node: r.root for r in found.labels.collect()}
    assert len(roots) == 66 and roots["alone"] == "alone" and len({roots[f"n{k}"] for k in range(65)}) == 1


def test_earliest_link_of_repeated_nodes(spark):
    """A node twice on a line, links in both directions and self links: the earliest by line and places stays."""
    places = {1: "abab", 2: "bacc", 3: "cba", 4: "dd", 5: "ddd", 0: "e"}
    routed = [(line, pos, "node", name) for line, names in places.items() for pos, name in enumerate(names)]
    got = people.line_links(spark.createDataFrame(routed, "line bigint, pos bigint, route string, node string").repartition(3))
    want = {}
    for line in sorted(places):
        for pos, name in enumerate(places[line][1:], 1):
            want.setdefault(frozenset((places[line][0], name)), (places[line][0], name, line, 0, pos))
    assert rows(got) == sorted(want.values())


def test_step_members_follow_one_group(spark, monkeypatch):
    """The jump tables hold steps of the group that is asked for, not of all groups."""
    from tracemesh.operators import forest

    routed = [(line, pos, "node", f"g{line % 20}n{line // 20 + pos}") for line in range(200) for pos in range(2)]
    routed = spark.createDataFrame(routed, "line bigint, pos bigint, route string, node string")
    groups = people.person_groups(people.line_links(routed))
    steps = formation.formation_steps(groups)
    last = steps.filter("group_id = 3").agg({"seq": "max"}).first()[0]
    sizes = []

    def written(df, name):
        table = materialise(df, name)
        sizes.append((name, table.count()))
        return table

    monkeypatch.setattr(forest, "materialise", written)
    found = {r.node for r in formation.step_members(groups, steps, last).collect()}
    assert found == {r.node for r in groups.members.filter("group_id = 3").collect()} and len(found) == 11
    assert steps.count() == 200 and 0 < max(n for name, n in sizes if name == "jumps") < 10


def test_steps_rise_once_a_round(spark, monkeypatch):
    """A deep tree of steps takes one table a round and one of the chains, however deep it is."""
    from tracemesh.operators import forest

    rng = random.Random(4)
    pairs = [(f"n{k}", f"n{k + 1}") for k in range(150)] + [(f"n{k % 9}", f"leaf{k}") for k in range(150)] + [("x", "y"), ("y", "z"), ("s", "s")]
    rng.shuffle(pairs)
    routed = [(line, pos, "node", name) for line, pair in enumerate(pairs) for pos, name in enumerate(pair)]
    groups = people.person_groups(people.line_links(spark.createDataFrame(routed, "line bigint, pos bigint, route string, node string")))
    people.merge_events(groups)
    written = []

    def counted(df, name):
        written.append(name)
        return materialise(df, name)

    monkeypatch.setattr(forest, "materialise", counted)
    monkeypatch.setattr(formation, "materialise", counted)
    steps = formation.formation_steps(groups).collect()
    assert len(written) <= len(groups.forest.rounds) + 1

    last, group, want = {}, {}, {}
    for line, (a, b) in enumerate(pairs):
        mine, other = group.setdefault(a, {a}), group.setdefault(b, {b})
        for side in {id(mine): mine, id(other): other}.values():
            if id(side) in last:
                want[last[id(side)]] = line
        both = mine | other
        last[id(both)] = line
        group.update(dict.fromkeys(both, both))
        group.setdefault("kept", []).append(both)  # so that no id is used twice
    line_of = {r.seq: r.line for r in steps}
    assert len(steps) == len(pairs) and {r.line: line_of[r.parent] for r in steps if r.parent is not None} == want
