"""Readers, writers and streams."""

import json
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracemesh import sources
from tracemesh.operators import entries, provenance, sessions, stats, templates
from tracemesh.streaming.streams import stream_collect, stream_entries, stream_sessions


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "log.txt"
    path.write_bytes(b"".join(b"line %d from 10.0.0.%d%s\n" % (n, n % 250, b"\r" if n % 3 == 0 else b"") for n in range(1, 5001)))
    return path


def test_line_numbers_over_many_blocks(spark, log, tmp_path):
    other = tmp_path / "other.txt"
    other.write_text("a\n\nb")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "10000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        try:
            got = sources.read_log(spark, str(tmp_path / "*.txt")).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(r.line for r in got if r.path.endswith("log.txt")) == list(range(1, 5001))
        assert all(r.text == f"line {r.line} from 10.0.0.{r.line % 250}" for r in got if r.path.endswith("log.txt"))
        assert sorted((r.line, r.text) for r in got if r.path.endswith("other.txt")) == [(1, "a"), (2, ""), (3, "b")]
    picked = sources.read_log(spark, str(log), limit=10, sample=3)
    assert sorted(r.line for r in picked.collect()) == [3, 6, 9]


def test_line_counts(spark, log, tmp_path):
    assert sources.estimate_lines(spark, str(log)) == 5000
    counted = {r.location.split("/")[-1]: (r["size"], r.events) for r in sources.count_events(spark, str(tmp_path)).collect()}
    assert counted == {"log.txt": (log.stat().st_size, 5000)}
    records = provenance.build_records(spark, str(tmp_path), "me", "2024-01-01T00:00:00Z", owner="o").collect()
    facts = {r.location.split("/")[-1]: json.loads(r.json) for r in records}
    assert facts["log.txt"]["data facts"]["metrics"]["event count"] == 5000
    assert facts["log.txt"]["entry"]["processing type"] == "collection"


def test_entries_round_trip(spark, log, tmp_path):
    found = entries.extract_entries(sources.read_log(spark, str(log), limit=50).drop("path"))
    sources.write_entries(found, str(tmp_path / "out"))
    back = sources.read_entries(spark, str(tmp_path / "out"), lines=True)
    assert rows(back.select("line", "type", "value")) == rows(found.select("line", "type", "value"))
    array = tmp_path / "entries.json"
    array.write_text(json.dumps([{"line": n, "timestamp": "", "type": "IP", "value": str(n)} for n in range(20)], indent=1))
    first = sources.read_entries(spark, str(array), limit=3)
    assert [(r.line, r.pos) for r in first.collect()] == [(0, 0), (1, 1), (2, 2)]


def test_idrows_and_sessions(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text(
        '"quoted"\n\n1, 2024-01-01T00:00:00Z, IP, a,b\n2, 2024-01-01T02:00:00.500+02:00, User, u \nx, 2024-01-01 00:00:00, IP, c\n'
        "3, 2024-01-01 00:00:09.25, IP, d\n4, yesterday, IP, e\n5, 2024-01-01 00:00:00\n"
    )
    df = sources.read_idrows(spark, str(path))
    assert rows(df.select("row_number", F.unix_millis("ts"), "type", "value")) == [
        (1, 1704067200000, "IP", "a,b"), (2, 1704067200500, "User", "u"), (3, 1704067209250, "IP", "d"),
    ]
    sources.write_sessions(sessions.gap_sessions(df), str(tmp_path / "sessions"))
    assert spark.read.json(str(tmp_path / "sessions/sessions")).count() == 2
    assert spark.read.json(str(tmp_path / "sessions/rows")).count() == 3


def test_small_tables(spark, tmp_path):
    stop = tmp_path / "stop.txt"
    stop.write_text("# note\n a \n\nb\nb\n")
    assert rows(sources.read_stoplist(spark, str(stop))) == [("a",), ("b",)]
    vectors = tmp_path / "vec.json"
    vectors.write_text("[1, 2]\n[1, 3]\n")
    assert rows(sources.read_vectors(spark, str(vectors))) == [(1, [1, 2]), (2, [1, 3])]
    records = tmp_path / "rec.json"
    records.write_text('{"a": 1}\n{"a": 2}\n')
    dictionary = templates.build_dictionary(sources.read_json_records(spark, str(records)))
    sources.write_dictionary(dictionary, str(tmp_path / "dict"))
    assert rows(sources.read_dictionary(spark, str(tmp_path / "dict")).select("token_text", "token")) == [('"a"', 1001), ("1", 1002), ("2", 1003)]
    book = tmp_path / "book.json"
    book.write_text('{\n "entry": {"author": "x"}\n}')
    assert json.loads(sources.read_records(spark, str(book)).first().json)["entry"]["author"] == "x"


def test_stats_file(spark, log, tmp_path):
    lines = sources.read_log(spark, str(log))
    found = entries.classify_lines(lines)
    sources.write_stats(stats.category_stats(found), stats.run_summary(lines, found, "log.txt"), str(tmp_path / "stats"))
    got = spark.read.json(str(tmp_path / "stats")).first()
    assert got.summary.total_lines_processed == 5000
    assert (got.categories[0].category, got.categories[0]["count"]) == ("ip", 5000)


def test_streams(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.json").write_text('{"line": 1, "text": "mail a@b.cd"}\n')
    lines = spark.readStream.schema("line bigint, text string").json(str(inbox))
    query = stream_entries(lines).writeStream.format("memory").queryName("entries_out").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.type, r.value) for r in spark.table("entries_out").collect()} == {("Email", "a@b.cd"), ("DNSName", "b.cd")} - {("DNSName", "b.cd")}

    rows_in = tmp_path / "rows"
    rows_in.mkdir()
    times = ["00:00:00.000", "00:00:01.000", "00:00:03.000", "00:01:00.000"]
    (rows_in / "a.json").write_text("".join(json.dumps({"ts": f"2024-01-01T{t}Z", "type": "IP", "value": t}) + "\n" for t in times))
    source = spark.readStream.schema("ts timestamp, type string, value string").json(str(rows_in))
    query = stream_sessions(source).writeStream.format("memory").queryName("sessions_out").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("sessions_out").select("rows", "value")) == [(1, "00:00:03.000"), (2, "00:00:01.000")]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_streamed_sessions_keep_the_last_value_per_type(spark, tmp_path, kind):
    """Three shuffled pieces and a restart give what the batch operator gives on all rows."""
    rng = random.Random(6)
    begin = datetime(2024, 1, 1)
    data = []
    for n in range(600):
        at = begin + timedelta(milliseconds=rng.choice([500, 1000, 1001]) * rng.randrange(2000))
        data.append((n, str(at), rng.choice(["a", "b", None]), rng.choice(["IP", "Host", None]), rng.choice([None, f"v{n}"])))
    data += [(n + 1000, t, k, kind_, f"w{n}") for n, t, k, kind_, _ in data[:100]]  # the same times again: the row number decides
    rng.shuffle(data)
    schema = "row_number bigint, ts string, user string, type string, value string"
    inbox, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))

    def table(piece):
        return spark.createDataFrame(piece, schema).withColumn("ts", F.col("ts").cast(kind))

    def run():
        source = spark.readStream.schema(schema.replace("ts string", f"ts {kind}")).parquet(inbox)
        found = stream_collect(source, ["IP", "Host", None], 1000, "1 day", ["user"])
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    for piece in (data[:250], data[250:400]):
        table(piece).coalesce(1).write.mode("append").parquet(inbox)
        run()
    assert spark.read.parquet(out).isEmpty()  # nothing is closed within a day
    table([*data[400:], (5000, "2024-01-09 00:00:00", "a", "IP", "closing")]).coalesce(1).write.mode("append").parquet(inbox)
    run()
    tagged = sessions.gap_sessions(table(data), 1000, ["user"])
    expected = sessions.session_collect(tagged, ["user"]).select("user", "session", "type", "value")
    got = spark.read.parquet(out)
    if kind == "timestamp":
        expected = expected.withColumn("session", F.col("session").cast("timestamp"))
    assert rows(got) == rows(expected)
    assert len(rows(got)) > 200

    table([(1, "2024-02-09 00:00:00", "a", "Other", "x")]).write.mode("append").parquet(inbox)
    with pytest.raises(Exception, match="a type that was not given: Other"):
        run()


def test_counts_of_odd_paths_and_mixed_line_lengths(spark, tmp_path):
    files = {"x y.log": "a\nb\nc\n", "z%20w.log": "a\nb\n", "long.log": ("x" * 5000 + "\n") * 2000, "short.log": "s\n" * 2000}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    counted = {r.location.split("/")[-1]: (r["size"], r.events) for r in sources.count_events(spark, str(tmp_path)).collect()}
    assert counted == {name: (len(text), text.count("\n")) for name, text in files.items()}
    assert sources.estimate_lines(spark, str(tmp_path)) == 4005
    assert sources.read_log(spark, str(tmp_path)).groupBy("path").count().count() == 4


def test_lines_of_unknown_blocks_are_an_error(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(2000)))
    lines = sources.read_log(spark, str(tmp_path))
    assert lines.count() == 2000
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        with pytest.raises(Exception, match="between two passes"):
            lines.select("line", "text").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_read_log_does_not_shuffle_the_text(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"{k}.log").write_text("line\n" * (k + 1))
    plan = sources.read_log(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    above_text = plan[: plan.index("FileScan text")]
    assert "Exchange" not in above_text.split("BroadcastExchange")[0]
    assert plan.count("FileScan text") == 1
