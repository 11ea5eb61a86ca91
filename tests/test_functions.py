"""Value and extraction literals."""

import pytest
from pyspark.sql import functions as F

from tracemesh import functions as T

VALID = {
    "address": ["7 Lake Road", "21 Birch St.", "90210 Canal Avenue", "5 Fir Rd", "300 Grand Boulevard"],
    "dnsname": ["mesh.org", "db.mesh.org", "eu-west.db.mesh.co.uk", "ntp.mesh.net.]", "ns.mesh."],
    "email": ["ann@mesh.org", "ann.lee@mesh.org", "ann+logs@mesh.org", "a77@mesh.co.uk", "ann-lee@my-mesh.org", "ann@mesh..org"],
    "ip": ["172.16.9.8", "8.0.0.250", "255.0.0.255", "fe80:0db8:0000:0000:0000:8a2e:0001:1111", "fd00:1::5:6", "::7", "::", "at fd00:: end"],
    "mac": ["A0:B1:C2:D3:E4:F5", "A0-B1-C2-D3-E4-F5", "a0:b1:c2:d3:e4:f5", "00:00:00:00:00:00"],
    "phonenumber": ["555-010-7788", "(555) 010-7788", "+1 555-010-7788", "555.010.7788", "5550107788", "+15550107788", "555-01-778", "4321"],
    "pid": ["4321", "80808", "PID: 77", "[77]", "PID:77", "5", "7654321", "PID 77", "[77"],
    "time": [
        "10:20:30", "10:20", "9:05", "22:10", "00:00:01", "10:20 AM", "9:05 PM", "08:07:06 PM", "10.20.30", "10.20 AM", "2210", "0905",
        "22:10 UTC", "22:10+0300", "T22:10Z", "22:10:05+0300", "2023-03-04 05:06:07", "2023-03-04T05:06:07.250Z", "2023-03-04T05:06:07Z",
        "2023-03-04T05:06:07.250+02:00",
    ],
    "tty": ["/dev/tty3", "/dev/console2", "/dev/ttys004", "/dev/ttyS0", "/dev/ttyUSB7", "/dev/ttyACM5", "tty9"],
    "url": [
        "http://mesh.org", "https://mesh.org", "http://www.mesh.org", "http://mesh.org/logs", "http://mesh.org/logs?day=3", "http://mesh.org:9000",
        "http://172.16.9.8", "ftp://files.mesh.org",
    ],
}
INVALID = {
    "address": ["77", "Lake Road", "77 %&/", "77 Lake xyz", "7 Lake Road\n"],
    "dnsname": ["mesh", ".org", "mesh..org", "me sh.org", "-mesh.org", "mesh-.org", "mesh.org-", "ann.lee@mesh.org", "q.r.s.t.u.v.w", "07.250Z"],
    "email": ["ann@", "@mesh.org", "ann@mesh", "ann@.org", "ann lee@mesh.org", "ann@my_mesh.org", "a@mesh.org\n"],
    "ip": ["172.16.9", "172.16.9.256", "400.16.9.8", "172.16.9.8.7", "172.16.9,8", "10:20:30"],
    "mac": ["A0:B1:C2:D3:E4", "A0:B1:C2:D3:E4:F5:06", "A0:B1:C2:D3:E4:GG", "A0B1C2D3E4F5", "A0 B1 C2 D3 E4 F5"],
    "phonenumber": ["none", "9.9.9.9", "172.16.9.8"],
    "pid": ["77b88", "pid: 77", "87654321"],
    "time": ["24:01:00", "10:61:00", "10:20:61", "10:20 XM", "10-20-30", "22:10 +03:00", "22:10:05Z", "960000000", "9.9.9", "10.75"],
    "tty": ["/dev/tty", "/dev/ttyq7", "dev/tty3", "/dev/tty3b", "tty", "/dev/pts/4", "pts/4"],
    "url": ["mesh.org", "http://", "http:/mesh.org", "http:mesh.org", "http://mesh", "http://..org", "http://ann:pw@mesh.org"],
}
CASES = [(name, value, True) for name in VALID for value in VALID[name]] + [
    (name, value, False) for name in INVALID for value in INVALID[name]
]

EXTRACTIONS = [
    ("dnsname", "Sync with ntp.mesh.org.] or mesh.net today.", ["ntp.mesh.org", "mesh.net"]),
    ("dnsname", "a@mail.mesh.org then mail.mesh.org and b.mesh.net b.mesh.net", ["b.mesh.net"]),
    ("dnsname", "mail.mesh.org then a@mail.mesh.org", ["mail.mesh.org"]),
    ("dnsname", "at 2023-03-04T05:06:07.250Z from 10.0.0.1", []),
    ("username", "Mar  4 05:06:07 node sshd[77]: Invalid user ftp from 10.1.1.9", ["ftp"]),
    ("username", "Mar  4 05:06:09 node sshd[78]: Failed password for invalid user guest from 10.1.1.9", ["guest"]),
    ("username", 'Accepted publickey for eve from 1.1.1.1 {"host": "h1"} {"host":"h2"}', ["eve", "h1", "h2"]),
    ("email", "a@b.co, a@b.co; none", ["a@b.co", "a@b.co"]),
    ("ip", "999.1.1.1 and 10.0.0.1:80", ["999.1.1.1", "10.0.0.1"]),
    ("mac", "x A0:B1:C2:D3:E4:F5 y a0b1c2d3e4f5 z", ["A0:B1:C2:D3:E4:F5", "a0b1c2d3e4f5"]),
    ("phonenumber", "call 555-010-7788 or 5550107788", ["555-010-7788", "5550107788", "5550107788"]),
    ("phonenumber", "port :5550107788 and 5550107788", ["5550107788", "5550107788"]),
    ("pid", "PID:12 pid 34 sshd[567] [PID: 89]", ["12", "34", "567", "89"]),
    ("time", "at 10:20:30 and 9.9.9", ["10:20:30"]),
    ("time", "on 2023-03-04 at 0905", ["2023", "0905"]),
    ("time", "on 1/2024/5 or 3-2024-1 at 0905", ["0905"]),
    ("time", "2023-03-04T05:06:07 stamp 1612345678", ["06:07", "2023", "2023-03-04T05:06:07", "1612345678"]),
    ("tty", "on pts/3 tty:4 tty=ssh", ["pts/3", "pts/3", "tty:4", "tty=ssh"]),
    ("url", "see http://www.mesh.org/a/b?c=d now", ["http://www.mesh.org/a/b?c=d", "www.mesh.org/a/b?c=d"]),
    ("address", "7 Lake Road", ["7 Lake Road"]),
    ("address", "at 7 Lake Road", []),
]


def test_predicates(spark):
    values = spark.createDataFrame(CASES, "name string, value string, expected boolean")
    tested = F.coalesce(*[F.when(F.col("name") == name, test(F.col("value"))) for name, test in T.MATCHERS.items()])
    wrong = values.filter(tested != F.col("expected")).collect()
    assert wrong == []


def test_classifier(spark):
    values = ["ann@mesh.org", "172.16.9.8", "2210", "^^", ""]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = {r[0]: (r[1], r[2]) for r in df.select("value", T.classify(F.col("value")), T.is_any_match(F.col("value"))).collect()}
    assert got["ann@mesh.org"] == (["email"], True)
    assert "ip" in got["172.16.9.8"][0]
    assert got["2210"] == (["phonenumber", "pid", "time"], True)
    assert got["^^"] == ([], False)
    assert got[""] == ([], False)


@pytest.mark.parametrize("name,value,expected", [("email", "ann at mesh", False), ("ip", "somewhere", False), ("ip", "10.0.0.1", True)])
def test_matcher_registry(spark, name, value, expected):
    assert spark.range(1).select(T.matcher(name)(F.lit(value))).first()[0] is expected


def test_extractors(spark):
    functions = {**T.EXTRACTORS, "username": T.extract_usernames}
    df = spark.createDataFrame([(i, name, text) for i, (name, text, _) in enumerate(EXTRACTIONS)], "i int, name string, text string")
    got = df.select("i", F.coalesce(*[F.when(F.col("name") == n, f(F.col("text"))) for n, f in functions.items()]).alias("x"))
    wrong = [(EXTRACTIONS[r.i], r.x) for r in got.collect() if r.x != EXTRACTIONS[r.i][2]]
    assert wrong == []


def test_line_timestamp(spark):
    texts = ["Mar 14 05:06:07 x 2024-01-02 03:04:05,1", "Mar 14 05:06:07 node", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(T.line_timestamp(F.col("text"))).collect()] == ["2024-01-02 03:04:05", "Mar 14 05:06:07", ""]


def test_times(spark):
    stamps = ["2024-12-16 23:38:50", "Dec 16 23:38:50", "dec  6 01:02:03", "2024-12-16T23:38:50", "2024-13-16 23:38:50", "N/A", "", None]
    df = spark.createDataFrame([(s,) for s in stamps], "s string")
    got = [str(r[0]) for r in df.select(T.parse_ts(F.col("s"), 2023)).collect()]
    assert got == ["2024-12-16 23:38:50", "2023-12-16 23:38:50", "2023-12-06 01:02:03"] + ["None"] * 5
    assert str(T.parse_bound("2024-01-02T03:04")) == "2024-01-02 03:04:00"
    assert T.parse_bound("x") is None and T.parse_bound(None) is None


def test_labels(spark):
    df = spark.createDataFrame(
        [("Email", "a.b@c-d"), ("URL", "http://x.y/z?q=1"), ("Other", "v[1]")], "type string, value string"
    )
    got = df.select(T.node_key(F.col("type"), F.col("value")), T.node_label(F.col("type"), F.col("value"))).collect()
    assert [tuple(r) for r in got] == [
        ("Email_a_b_c_d", "Email_a_b_c_d([Email<br/>a.b_AT_c-d])"),
        ("URL_http_x_y_z_q_1", "URL_http_x_y_z_q_1([URL<br/>http://x.y/z])"),
        ("Other_v_1_", "Other_v_1_([Other<br/>v_1]])"),
    ]
    stripped = df.select(T.strip_query(F.col("value"))).collect()
    assert stripped[1][0] == "http://x.y/z"


def test_scans_of_many_tasks_move_no_text(spark, sf_dir):
    """Extractors, predicates on lines and classification work where the text was read."""
    from tracemesh.plans.queries import QUERIES

    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        for name in ("extract_email", "extract_time", "classify_lines", "scan_findings", "extract_entries"):
            plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert "Scan parquet" in plan and "Exchange" not in plan, name
    finally:
        spark.conf.set(key, old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_scans_of_few_row_groups_get_tasks_by_rows(spark, tmp_path):
    """A file that is cut into many splits but holds one row group is read by one task; the rows are dealt out."""
    from tracemesh.session import spread

    path = str(tmp_path / "one")
    spark.range(1000).coalesce(1).write.parquet(path)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        table = spark.read.parquet(path)
        assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in spread(table, "id", 100).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) < 200
        for unchanged in (spread(table, "id", 1000), spread(table, "id")):
            assert "Exchange" not in unchanged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_values_are_classified_once(spark, sf_dir):
    """The pattern of a category is in one place of the plan, not in a filter and again in the result."""
    from tracemesh.functions import patterns as P
    from tracemesh.plans.queries import QUERIES

    for name in ("classify_values", "matcher", "is_any_match"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(P.spark_regex(P.TTY)) == 1, name


def test_cheap_tests_lose_nothing(spark):
    """Values and lines that only just pass the tests made before the patterns."""
    values = ["1:2:3:4:5:6:7:8", "x1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "a::", "::", "q a:b::c:d", "ab-cd-ef-ab-cd-ef", "٣٤٥", "word"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = [tuple(r) for r in df.select(T.MATCHERS["ip"](F.col("value")), T.classify(F.col("value")), T.is_any_match(F.col("value"))).collect()]
    assert [r[0] for r in got] == [True, False, False, True, True, True, False, False, False]
    assert got[6][1] == ["mac"] and "pid" in got[7][1] and got[8][1] == []
    assert [r[2] for r in got] == [bool(r[1]) for r in got]
    lines = ["a0b1c2d3e4f5", " a0b1c2d3e4f5", "\na0b1c2d3e4f5\n", "\U0001f600a0b1c2d3e4f5é", " a0b1c2d3e4f5 a0b1c2d3e4f5 ", " a0b1c2d3e4f50 ", " a0b1c2d3e4f5,0b1c2d3e4f5a;"]
    df = spark.createDataFrame([(v,) for v in lines], "text string")
    assert [len(r[0]) for r in df.select(T.extract_macs(F.col("text"))).collect()] == [0, 0, 1, 1, 1, 0, 1]


def test_logs_and_records_are_dealt_out_by_rows(spark, sf_dir, monkeypatch):
    """The events are one row group; what is parsed of them is parsed in a task per so many rows."""
    from tracemesh.plans import inputs

    monkeypatch.setattr(inputs, "TASK_ROWS", 100)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for made in (inputs.event_log, inputs.event_records):
        assert made(spark, sf_dir).rdd.getNumPartitions() == -(-rows // 100), made.__name__


def test_encoding_in_one_parse(spark, sf_dir):
    from tracemesh.operators import templates
    from tracemesh.plans import inputs

    records = inputs.event_records(spark, sf_dir)
    vectors, dictionary = templates.encode(records)
    apart = templates.build_dictionary(records)
    assert sorted(map(tuple, dictionary.collect())) == sorted(map(tuple, apart.collect()))
    assert sorted(map(tuple, vectors.collect())) == sorted(map(tuple, templates.tokenise(records, apart).collect()))
