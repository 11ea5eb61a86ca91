"""One query per operator: ``(spark, sf_dir) -> DataFrame`` over the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemesh import functions as T
from tracemesh import sources
from tracemesh.operators import activity as act
from tracemesh.operators import cover, entries, formation, identities, kept, people, provenance, search, search_index, sessions, stats, templates
from tracemesh.plans import inputs as I
from tracemesh.session import materialise
from tracemesh.streaming import streams
from tracemesh.sources.kept import KeptTables

Query = Callable[[SparkSession, str], DataFrame]
YEAR = 2024
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _text_of(stamp) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _joined(array) -> Column:
    return F.array_join(F.col(array).cast("array<string>"), ",")


# --- extractors, predicates --------------------------------------------------


def _extraction(extract) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return I.all_text(spark, sf).select("src", "id", F.explode(extract(F.col("text"))).alias("value"))

    return run


for _name, _extract in {**T.EXTRACTORS, "username": T.extract_usernames}.items():
    QUERIES[f"extract_{_name}"] = _extraction(_extract)


def _predicate(test) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return I.values(spark, sf).filter(test(F.col("value")))

    return run


for _name, _test in T.MATCHERS.items():
    QUERIES[f"is_{_name}"] = _predicate(_test)


@query
def matcher(spark, sf):
    """Every value with the names of the predicates that accept it, each looked up by its name."""
    names = F.array_compact(F.array(*[F.when(T.matcher(name)(F.col("value")), F.lit(name)) for name in sorted(T.MATCHERS)]))
    return _named(I.values(spark, sf), names).select("value", _joined("n").alias("names"))


def _named(values: DataFrame, names: Column) -> DataFrame:
    """Values that have any of ``names``, as ``n``: worked out once, where a filter would work them out again."""
    return values.select("value", F.explode(F.filter(F.array(names), lambda n: F.size(n) > 0)).alias("n"))


@query
def is_any_match(spark, sf):
    """Tested on the distinct values: Spark would move a filter below the distinct, to every occurrence of a value."""
    value = F.filter(F.array("value"), T.is_any_match)
    return I.values(spark, sf).select(F.explode(value).alias("value"))


QUERIES["is_timestamp_fragment"] = _predicate(T.is_timestamp_fragment)


@query
def classify_values(spark, sf):
    return _named(I.values(spark, sf), T.classify(F.col("value"))).select("value", _joined("n").alias("categories"))


@query
def line_timestamp(spark, sf):
    stamped = I.text_lines(spark, sf).select("src", "id", "line", T.line_timestamp(F.col("text")).alias("stamp"))
    return stamped.filter("stamp <> ''")


# --- scans over lines ----------------------------------------------------------


@query
def classify_lines(spark, sf):
    found = entries.classify_lines(I.text_lines(spark, sf))
    return found.select("src", "id", "line", "value", _joined("categories").alias("categories"))


@query
def classify_lines_filtered(spark, sf):
    found = entries.classify_lines(I.text_lines(spark, sf), include="ip, email,time", exclude="pid,phonenumber")
    return found.select("src", "id", "line", "value", _joined("categories").alias("categories"))


@query
def category_stats(spark, sf):
    return stats.category_stats(entries.classify_lines(I.text_lines(spark, sf)))


@query
def run_summary(spark, sf):
    lines = I.text_lines(spark, sf)
    return stats.run_summary(lines, entries.classify_lines(lines), "all")


@query
def extract_entries(spark, sf):
    return entries.extract_entries(I.text_lines(spark, sf)).drop("pos")


@query
def scan_findings(spark, sf):
    return entries.scan_findings(I.text_lines(spark, sf)).drop("pos")


@query
def scan_findings_stats(spark, sf):
    return stats.category_stats(entries.scan_findings(I.text_lines(spark, sf), exclude="url"))


@query
def findings_sample(spark, sf):
    found = entries.scan_findings(I.text_lines(spark, sf))
    return stats.findings_sample(found, ["src", "id", "line", "pos"]).select("src", "id", "line", "category", "value")


@query
def scan_stats_basic(spark, sf):
    return stats.category_stats(entries.scan_stats_basic(I.text_lines(spark, sf)))


@query
def limit_and_sample(spark, sf):
    picked = entries.limit_lines(I.text_lines(spark, sf), limit=20, sample=2)
    return picked.select("src", "id", "line", F.length("text").cast("bigint").alias("chars"))


# --- frequencies and identities ---------------------------------------------------


@query
def filter_types(spark, sf):
    kept = entries.filter_types(I.event_entries(spark, sf), "Username, IP,Hostname", "Hostname")
    return kept.select("line", "pos", "type", "value")


@query
def value_frequency(spark, sf):
    return stats.value_frequency(I.order_entries(spark, sf))


@query
def distinct_lines(spark, sf):
    return stats.line_count(I.order_entries(spark, sf))


@query
def frequency_report(spark, sf):
    return stats.frequency_report(I.order_entries(spark, sf))


@query
def qualifying_values(spark, sf):
    return stats.qualifying_values(I.order_entries(spark, sf), "part", max_freq=0.2)


@query
def value_lines(spark, sf):
    return stats.value_lines(I.order_entries(spark, sf))


@query
def identities_greedy(spark, sf):
    tagged = identities.identities(I.event_entries(spark, sf), "Username,IP,Hostname", max_freq=10.0)
    return tagged.select("line", "type", "value", "identity")


@query
def identities_greedy_rare(spark, sf):
    tagged = identities.identities(I.event_entries(spark, sf), "IP,Hostname", max_freq=0.9)
    return tagged.select("line", "type", "value", "identity")


def _part_identities(spark, sf):
    """Orders that are linked by rare parts, directly or through other orders."""
    return identities.identities(I.order_entries(spark, sf), "part", max_freq=0.15, mode="components")


@query
def identities_components(spark, sf):
    return _part_identities(spark, sf).select("line", "identity").distinct()


@query
def kept_identities(spark, sf):
    """Orders that share parts, taken in three deltas; the first order names the identity."""
    entries = I.order_entries(spark, sf)
    rare = entries.join(stats.qualifying_values(entries, "part", 0.15, greedy=False).select("type", "value"), ["type", "value"], "left_semi")
    alone = entries.select("line").distinct().select("line", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("value"))
    rows = materialise(rare.select("line", "type", "value").unionByName(alone), "order-values")
    tables = KeptTables(spark, I.scratch(spark, "identities"))
    for n in range(3):
        now = kept.add_lines(tables, rows.filter(F.col("line") % 3 == n))
    return kept.kept_identities(now)


@query
def identity_summary_orders(spark, sf):
    return stats.identity_summary(_part_identities(spark, sf))


@query
def search_identity_orders(spark, sf):
    found = identities.search_identity(_part_identities(spark, sf), "part:p7")
    return found.select("line", "type", "value", "identity")


def _ip_identities(spark, sf):
    return identities.identities(I.event_entries(spark, sf), "IP", mode="components")


@query
def identity_summary(spark, sf):
    return stats.identity_summary(_ip_identities(spark, sf))


@query
def search_identity(spark, sf):
    found = identities.search_identity(_ip_identities(spark, sf), "IP:10.0.8.69", cap=1000)
    return found.select("line", "pos", "timestamp", "type", "value", "identity")


@query
def search_outcome(spark, sf):
    return identities.search_outcome(_ip_identities(spark, sf), "Event:click", cap=100)


@query
def trace_identity(spark, sf):
    """The entries of the first identity, written and read back."""
    path = I.scratch(spark, "identity")
    sources.write_entries(identities.trace_identity(_ip_identities(spark, sf), 1), path)
    return sources.read_entries(spark, path, lines=True).select("line", "timestamp", "type", "value", "identity")


# --- sessions -------------------------------------------------------------------------


@query
def gap_sessions(spark, sf):
    tagged = sessions.gap_sessions(I.event_rows(spark, sf), gap_ms=120_000)
    return tagged.select("row_number", _text_of("session").alias("session"))


@query
def gap_sessions_per_user(spark, sf):
    tagged = sessions.gap_sessions(I.event_rows(spark, sf), gap_ms=6 * 3_600_000, keys=["user_id"])
    totals = sessions.session_summary(tagged, keys=["user_id"])
    return totals.select("user_id", _text_of("start").alias("start"), _text_of("end").alias("end"), "rows")


@query
def session_collect(spark, sf):
    tagged = sessions.gap_sessions(I.event_rows(spark, sf), gap_ms=120_000)
    return sessions.session_collect(tagged).select(_text_of("session").alias("session"), "type", "value")


@query
def stream_collect_per_user(spark, sf):
    """The events as a stream: the last value per type of each session of a user that a day of lateness has closed."""
    path, state = I.scratch(spark, "stream"), I.scratch(spark, "stream-state")
    schema = I.load(spark, sf, "events").schema
    stream = I.event_identities(spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]"))  # a pattern may be a file or a folder
    types = ["click", "error", "purchase", "signup", "view"]
    found = streams.stream_collect(stream, types, gap_ms=6 * 3_600_000, late="1 day", keys=["user_id"])
    found.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(path).select("user_id", _text_of("session").alias("session"), "type", "value")


# --- nodes and groups -----------------------------------------------------------------


def _stoplist(spark, sf):
    return I.events(spark, sf).filter("event_type = 'signup'").select(F.col("event_type").alias("value")).distinct()


def _routed(spark, sf):
    """Users and their addresses as nodes; hosts are switched off and, like event types, filtered."""
    return people.route_entries(I.event_entries(spark, sf).drop("group_id"), exclude=["Hostname"])


def _groups(spark, sf):
    routed = _routed(spark, sf)
    return routed, people.person_groups(people.line_links(routed))


@query
def route_entries(spark, sf):
    routed = people.route_entries(I.event_entries(spark, sf), _stoplist(spark, sf), exclude=["Hostname"])
    return routed.select("line", "pos", "type", "value", "route", "node")


@query
def time_range(spark, sf):
    kept = entries.time_range(I.event_entries(spark, sf), datetime(2024, 1, 5), T.parse_bound("2024-01-20T12:00"), YEAR)
    return kept.select("line", "pos", "timestamp")


@query
def node_labels(spark, sf):
    kept = entries.extract_entries(I.text_lines(spark, sf)).select("type", "value").distinct()
    type_ = T.normalise_type(F.col("type"))
    return kept.select(
        "type", "value", T.clean_id(F.col("value")).alias("clean"), T.node_label(type_, F.col("value")).alias("label"),
        T.strip_query(F.col("value")).alias("shown"), T.vkey(type_, F.col("value")).alias("vkey"),
    )


@query
def line_links(spark, sf):
    return people.line_links(_routed(spark, sf))


@query
def person_groups(spark, sf):
    return _groups(spark, sf)[1].members


@query
def person_groups_all_types(spark, sf):
    routed = people.route_entries(I.event_entries(spark, sf).drop("group_id"))
    return people.person_groups(people.line_links(routed)).members


@query
def singleton_groups(spark, sf):
    """Only addresses that host several events share a line with nobody: hosts are nodes, one per line."""
    routed = people.route_entries(I.event_entries(spark, sf).drop("group_id"), exclude=["Username", "IP"])
    return people.singleton_groups(routed, people.person_groups(people.line_links(routed)))


@query
def merge_log(spark, sf):
    routed, groups = _groups(spark, sf)
    log = people.merge_log(groups, people.node_stats(routed, YEAR))
    return log.select("group_id", "step", "event", "a_value", "b_value", "new_member", "line")


@query
def merge_log_all_types(spark, sf):
    routed = people.route_entries(I.event_entries(spark, sf).drop("group_id"))
    groups = people.person_groups(people.line_links(routed))
    return people.merge_log(groups, people.node_stats(routed, YEAR), added="JOINED")


@query
def formation_graph(spark, sf):
    routed, groups = _groups(spark, sf)
    _, edges = formation.formation_graph(groups, people.merge_log(groups, people.node_stats(routed, YEAR)))
    return edges


@query
def formation_graph_all_types(spark, sf):
    routed = people.route_entries(I.event_entries(spark, sf).drop("group_id"))
    groups = people.person_groups(people.line_links(routed))
    _, edges = formation.formation_graph(groups, people.merge_log(groups, people.node_stats(routed, YEAR)))
    return edges


def _days(spark, sf):
    """Groups that merge, by the day."""
    routed = people.route_entries(I.day_entries(spark, sf))
    groups = people.person_groups(people.line_links(routed))
    return routed, groups, people.merge_log(groups, people.node_stats(routed, YEAR))


@query
def person_groups_days(spark, sf):
    return _days(spark, sf)[1].members


@query
def merge_log_days(spark, sf):
    return _days(spark, sf)[2].select("group_id", "step", "event", "a_value", "b_value", "new_member", "line")


@query
def formation_nodes_days(spark, sf):
    _, groups, log = _days(spark, sf)
    nodes, _ = formation.formation_graph(groups, log)
    return nodes.select("group_id", "step", "event", "a_value", "b_value", "new_member", "line")


@query
def formation_graph_days(spark, sf):
    _, groups, log = _days(spark, sf)
    return formation.formation_graph(groups, log)[1]


@query
def singleton_groups_days(spark, sf):
    routed, groups, _ = _days(spark, sf)
    return people.singleton_groups(routed, groups)


@query
def tuple_provenance_days(spark, sf):
    """Where the first and every later value of a group come from; many of them never share a line."""
    routed, groups, log = _days(spark, sf)
    first = log.filter("step = 1").select("group_id", "a_value")
    found = formation.tuple_provenance(log.select("group_id", "b_value").join(first, "group_id"), people.group_entries(routed, groups))
    return found.select("group_id", "a_value", "b_value", F.col("side").cast("bigint").alias("side"), "value", "line", "timestamp", "type", "tuple_line")


@query
def step_entries(spark, sf):
    """The members of the first group after its last step, with their first entries."""
    routed, groups = _groups(spark, sf)
    steps = formation.formation_steps(groups)
    last = steps.filter("group_id = 1").agg(F.max("seq").alias("m")).first()["m"]
    members = formation.step_members(groups, steps, last)
    return formation.step_entries(people.group_entries(routed, groups), members).select("shown", "line", "timestamp", "type", "value")


@query
def tuple_provenance(spark, sf):
    routed, groups = _groups(spark, sf)
    log = people.merge_log(groups, people.node_stats(routed, YEAR))
    found = formation.tuple_provenance(log, people.group_entries(routed, groups))
    return found.select("group_id", "a_value", "b_value", F.col("side").cast("bigint").alias("side"), "value", "line", "timestamp", "type", "tuple_line")


@query
def node_stats(spark, sf):
    return people.node_stats(_routed(spark, sf), YEAR)


@query
def technical_counts(spark, sf):
    return people.technical_counts(_routed(spark, sf))


@query
def technical_entries(spark, sf):
    """The filtered entries of the group that holds user u8."""
    routed, groups = _groups(spark, sf)
    group = groups.members.filter("node = 'User_u8'").select("group_id")
    members = groups.members.join(group, "group_id", "left_semi")
    return people.technical_entries(routed, members)


@query
def group_stats(spark, sf):
    routed, groups = _groups(spark, sf)
    return people.group_stats(routed, groups, YEAR)


@query
def group_summary(spark, sf):
    routed, groups = _groups(spark, sf)
    return people.group_summary(routed, groups, YEAR)


@query
def node_line_values(spark, sf):
    routed, groups = _groups(spark, sf)
    log = people.merge_log(groups, people.node_stats(routed, YEAR))
    return people.node_relationships(routed, groups, log)["line_values"]


@query
def node_last_entries(spark, sf):
    routed, groups = _groups(spark, sf)
    log = people.merge_log(groups, people.node_stats(routed, YEAR))
    return people.node_relationships(routed, groups, log)["last_entries"]


@query
def exclusion_catalogue(spark, sf):
    return people.exclusion_catalogue(_routed(spark, sf), _stoplist(spark, sf))


@query
def line_cover(spark, sf):
    grouped = I.event_entries(spark, sf)
    return cover.cover_values(grouped, cover.line_cover(grouped))


@query
def line_cover_days(spark, sf):
    """The cover of groups that merge, by the day."""
    routed, groups, _ = _days(spark, sf)
    grouped = people.group_entries(routed, groups)
    return cover.cover_values(grouped, cover.line_cover(grouped))


# --- activity, search -------------------------------------------------------------------


def _timed(spark, sf):
    return act.timed(I.user_entries(spark, sf), YEAR)


@query
def activity_per_hour(spark, sf):
    return act.activity(_timed(spark, sf), "hour").select("group_id", _text_of("key").alias("hour"), "cnt")


@query
def activity_per_value(spark, sf):
    return act.activity(_timed(spark, sf), "value").select("group_id", "key", "cnt", "first.line")


@query
def activity_summary(spark, sf):
    found = act.activity_summary(_timed(spark, sf))
    return found.withColumn("min_at", _text_of("min_at")).withColumn("max_at", _text_of("max_at"))


@query
def heatmap_segments(spark, sf):
    found = act.heatmap_segments(_timed(spark, sf))
    return found.withColumn("start", _text_of("start")).withColumn("end", _text_of("end"))


@query
def heatmap_statistics(spark, sf):
    return act.heatmap_statistics(_timed(spark, sf))[0]


@query
def heatmap_averages(spark, sf):
    return act.heatmap_statistics(_timed(spark, sf))[1]


@query
def heatmap_slice(spark, sf):
    return act.heatmap_slice(_timed(spark, sf), datetime(2024, 1, 3), datetime(2024, 1, 4, 12)).select("group_id", "line", "timestamp", "type", "value")


@query
def first_type_per_value(spark, sf):
    return act.first_type_per_value(_timed(spark, sf))


def _search(term: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        routed, groups = _groups(spark, sf)
        return search.search(routed, people.node_stats(routed, YEAR), groups, term)

    return run


QUERIES["search_value"] = _search("U12")
QUERIES["search_filtered"] = _search("purchase")
QUERIES["search_time"] = _search('"2024-01-07 1"')
QUERIES["search_value_and_time"] = _search('10.0.8. "2024-01-07"')


def _search_days(term: str) -> Query:
    """A search over the groups of the days by an index built for it."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        routed = people.route_entries(I.day_entries(spark, sf))
        groups = people.person_groups(people.line_links(routed))
        return search_index.build_index(routed, people.node_stats(routed, YEAR), groups, I.scratch(spark, "index")).search(term)

    return run


QUERIES["search_index_value"] = _search_days("U1")
QUERIES["search_index_text"] = _search_days("HOST-1-")
QUERIES["search_index_text_and_time"] = _search_days('ost-2-4@2024 "01-1"')
QUERIES["search_index_time"] = _search_days('"2024-01-07 1"')


@query
def search_index_filtered(spark, sf):
    routed, groups = _groups(spark, sf)
    return search_index.build_index(routed, people.node_stats(routed, YEAR), groups, I.scratch(spark, "index")).search("urchas")


@query
def node_details(spark, sf):
    return search.node_details(people.node_stats(_routed(spark, sf), YEAR), "User-u8-3")


@query
def line_details(spark, sf):
    routed, groups = _groups(spark, sf)
    found = people.group_entries(routed, groups)
    return search.line_details(found, 1, 0).select("line", "pos", "timestamp", "type", "value")


@query
def stoplist_toggle(spark, sf):
    kinds = I.events(spark, sf).select(F.col("event_type").alias("value")).distinct()
    return search.stoplist_toggle(search.stoplist_toggle(kinds, " click "), "logout")


@query
def kept_stoplist(spark, sf):
    """All versions of a kept stop list: the event types, then signups toggled, then logouts."""
    tables = KeptTables(spark, I.scratch(spark, "stoplist"))
    kinds = I.events(spark, sf).select(F.col("event_type").alias("value")).distinct()
    tables.commit(tables.snapshot(), replace={"stoplist": kinds})
    kept.toggle_stop_value(tables, "signup")
    kept.toggle_stop_value(KeptTables(spark, tables.folder), "logout")
    every = [tables.snapshot(v).read("stoplist").select(F.lit(v).cast("bigint").alias("version"), "value") for v in tables.versions()]
    return every[0].unionByName(every[1]).unionByName(every[2])


# --- templates ----------------------------------------------------------------------------


@query
def build_dictionary(spark, sf):
    return templates.build_dictionary(I.event_records(spark, sf))


@query
def dictionary_growth(spark, sf):
    """The dictionary of the events, saved, read back, and extended by the orders."""
    path = I.scratch(spark, "dictionary")
    sources.write_dictionary(templates.build_dictionary(I.event_records(spark, sf)), path)
    return templates.build_dictionary(I.order_records(spark, sf), existing=sources.read_dictionary(spark, path))


@query
def kept_dictionary(spark, sf):
    """The newest version of a kept dictionary, grown by the events and then the orders."""
    tables = KeptTables(spark, I.scratch(spark, "kept-dictionary"))
    kept.grow_dictionary(tables, I.event_records(spark, sf))
    return kept.grow_dictionary(tables, I.order_records(spark, sf)).read("dictionary")


def _hamming_links(d: int) -> Query:
    return lambda spark, sf: templates.hamming_links(_vectors(spark, sf)[0], d)


QUERIES.update({f"hamming_links_{d}": _hamming_links(d) for d in (1, 2, 3)})


def _vectors(spark, sf):
    return templates.encode(I.event_records(spark, sf))


@query
def tokenise(spark, sf):
    return _vectors(spark, sf)[0].select("vec_id", _joined("vec").alias("vec"))


@query
def detokenise(spark, sf):
    return templates.detokenise(*_vectors(spark, sf))


@query
def vector_lengths(spark, sf):
    return templates.vector_lengths(_vectors(spark, sf)[0])


@query
def hamming_partners(spark, sf):
    return templates.hamming_partners(_vectors(spark, sf)[0]).select("i", "j")


@query
def mine_rules(spark, sf):
    rules = templates.mine_rules(_vectors(spark, sf)[0])
    return rules.rules.select("rule_id", "i", "j", "p", "q", _joined("rule").alias("rule"))


@query
def rule_coverage(spark, sf):
    return templates.rule_coverage(templates.mine_rules(_vectors(spark, sf)[0]))


@query
def rule_values(spark, sf):
    vectors = _vectors(spark, sf)[0]
    return templates.shared_values(templates.rule_values(templates.mine_rules(vectors), vectors))


@query
def match_rules(spark, sf):
    vectors = _vectors(spark, sf)[0]
    return templates.match_rules(vectors, templates.mine_rules(vectors).rules)


@query
def retokenise(spark, sf):
    """The founding vectors of all rules, rebuilt from rule and values, as text."""
    vectors, dictionary = _vectors(spark, sf)
    rules = templates.mine_rules(vectors)
    rebuilt = templates.retokenise(rules, templates.rule_values(rules, vectors))
    return templates.detokenise(rebuilt.select((F.col("rule_id") * 2 + F.col("side")).alias("vec_id"), "vec"), dictionary)


# --- files and provenance ----------------------------------------------------------------


@query
def file_inventory(spark, sf):
    """Lines of the files of each language, with the number of files that could not be read."""
    found = sources.file_inventory(spark, _written_documents(spark, sf))
    return found.groupBy(_language("location").alias("lang")).agg(F.sum("events").alias("events"), F.count("error").alias("unreadable"))


def _written_documents(spark, sf) -> str:
    path = I.scratch(spark, "documents")
    I.load(spark, sf, "documents").select(F.col("text").alias("value"), "lang").write.partitionBy("lang").text(path)
    return path


def _language(path: str) -> Column:
    return F.regexp_extract(path, "lang=([^/]+)", 1)


@query
def read_log(spark, sf):
    lines = sources.read_log(spark, _written_documents(spark, sf) + "/*")
    per_file = lines.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.max("line").alias("last"), F.countDistinct("line").alias("different"), F.sum(F.length("text")).alias("chars")
    )
    return per_file.groupBy(_language("path").alias("lang")).agg(
        F.sum("n").alias("lines"), F.sum("last").alias("last"), F.sum("different").alias("different"), F.sum("chars").alias("chars")
    )


@query
def count_events(spark, sf):
    counts = sources.count_events(spark, _written_documents(spark, sf)).filter(F.col("location").contains("lang="))
    return counts.groupBy(_language("location").alias("lang")).agg(F.sum("events").alias("events"))


@query
def estimate_lines(spark, sf):
    n = sources.estimate_lines(spark, _written_documents(spark, sf) + "/*")
    return I.load(spark, sf, "documents").agg(F.count(F.lit(1)).alias("documents")).withColumn("lines", F.lit(n).cast("bigint"))


def _written_log(spark, sf) -> str:
    """The event log in files by ranges of its line numbers, in order."""
    path = I.scratch(spark, "log")
    log = I.event_log(spark, sf).repartitionByRange(6, "line").sortWithinPartitions("line")
    log.select(F.col("text").alias("value")).write.text(path)
    return path


@query
def read_log_first_lines(spark, sf):
    """Every third of the first 2,500 lines over all files of a log, which are the only ones read."""
    return sources.read_log(spark, _written_log(spark, sf), limit=2500, sample=3, across_files=True).select("line", "text")


@query
def read_log_first_of_each(spark, sf):
    """The first 40 lines of each file are lines of the log in order."""
    lines = sources.read_log(spark, _written_log(spark, sf), limit=40)
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.max("line").alias("last")).groupBy("lines", "last").agg(F.count(F.lit(1)).alias("files"))


@query
def line_estimates(spark, sf):
    """Lines per language, counted, and estimated from a fifth of the blocks of each file."""
    path = _written_documents(spark, sf) + "/*"
    exact = sources.line_estimates(spark, path).select("path", F.col("lines").alias("exact"))
    guessed = sources.line_estimates(spark, path, exact_below=0, share=0.2, block=4096).join(exact, "path")
    return guessed.groupBy(_language("path").alias("lang")).agg(
        F.sum("exact").cast("bigint").alias("lines"),
        F.max((F.abs(F.col("lines") - F.col("exact")) > 4 * F.col("error") + 1).cast("int")).cast("bigint").alias("far"),
        F.max((F.col("bytes_read") > 0.4 * F.col("size") + 16384).cast("int")).cast("bigint").alias("much_read"),
    )


@query
def read_entries(spark, sf):
    path = I.scratch(spark, "entries")
    sources.write_entries(I.event_entries(spark, sf).drop("pos"), path)
    read = sources.read_entries(spark, path, lines=True)
    return read.select("line", "timestamp", "type", "value")


@query
def read_idrows(spark, sf):
    """Identity rows written as text, read, and grouped into sessions."""
    path = I.scratch(spark, "rows")
    rows = I.event_rows(spark, sf)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows.select(F.concat_ws(", ", F.col("row_number").cast("string"), stamp, "type", "value").alias("value")).write.text(path)
    tagged = sessions.gap_sessions(sources.read_idrows(spark, path), gap_ms=300_000)
    return sessions.session_summary(tagged).select(_text_of("start").alias("start"), _text_of("end").alias("end"), "rows")


@query
def session_files(spark, sf):
    path = I.scratch(spark, "sessions")
    sources.write_sessions(sessions.gap_sessions(I.event_rows(spark, sf), gap_ms=300_000), path)
    rows = spark.read.json(f"{path}/rows").groupBy("session").agg(F.count(F.lit(1)).alias("listed"), F.min("row_number").alias("first_row"))
    types = spark.read.json(f"{path}/identities").groupBy("session").agg(F.count(F.lit(1)).alias("types"))
    ranges = spark.read.json(f"{path}/sessions").select("session", "rows")
    return ranges.join(rows, "session").join(types, "session").select("rows", "listed", "first_row", "types")


@query
def read_json_records(spark, sf):
    path = I.scratch(spark, "records")
    I.event_records(spark, sf).select(F.col("json").alias("value")).write.text(path)
    read = sources.read_json_records(spark, path)
    user = F.get_json_object("json", "$.user").cast("bigint")
    return read.agg(F.count(F.lit(1)).alias("records"), F.max("rec").alias("last"), F.countDistinct("rec").alias("different"), F.sum(user).alias("users"))


@query
def read_stoplist(spark, sf):
    path = I.scratch(spark, "stop")
    nations = I.load(spark, sf, "nation")
    marked = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("# "), "n_name")).otherwise(F.concat(F.lit(" "), "n_name", F.lit(" ")))
    nations.select(marked.alias("value")).write.text(path)
    return sources.read_stoplist(spark, path)


@query
def stats_file(spark, sf):
    lines = I.text_lines(spark, sf)
    found = entries.scan_findings(lines)
    path = I.scratch(spark, "stats")
    sources.write_stats(stats.category_stats(found), stats.run_summary(lines, found, "all"), path)
    read = spark.read.json(path).select("summary.total_lines_processed", "summary.total_classifications", F.explode("categories").alias("c"))
    return read.select("total_lines_processed", "total_classifications", "c.category", F.col("c.count").alias("cnt"), "c.percentage")


@query
def validate_records(spark, sf):
    return provenance.validate_records(I.document_records(spark, sf))


def _record_facts(record: DataFrame) -> DataFrame:
    part = lambda name: F.get_json_object("json", f"$['data facts'].{name}")
    return record.select(
        part("storage.location").alias("location"), part("metrics.size").cast("bigint").alias("size"), part("metrics['event count']").cast("bigint").alias("events")
    )


@query
def build_records_of_files(spark, sf):
    """Records of the files that the documents were written to; sizes and lines add up per language."""
    path = _written_documents(spark, sf)
    found = _record_facts(provenance.build_records(spark, path, "collector", "2024-01-01T00:00:00Z")).filter(F.col("location").contains("lang="))
    return found.groupBy(_language("location").alias("lang")).agg(F.sum("size").alias("size"), F.sum("events").alias("events"))


@query
def read_records(spark, sf):
    """A record per source, each in a file of its own, read back."""
    facts = I.load(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("size"), F.count(F.lit(1)).alias("events"))
    records = provenance.make_records(facts.withColumn("location", F.col("source")), "collector", "2024-01-01T00:00:00Z", F.col("source"))
    path = I.scratch(spark, "book")
    records.select(F.col("location").alias("source"), F.col("json").alias("value")).write.partitionBy("source").text(path)
    return _record_facts(sources.read_records(spark, f"{path}/source=*"))


@query
def build_records(spark, sf):
    """A collection record per document source, written, read back and checked."""
    documents = I.load(spark, sf, "documents")
    facts = documents.groupBy("source").agg(
        F.sum("n_chars").alias("size"), F.sum(F.size(F.split("text", "\n"))).alias("events")
    ).select(F.concat(F.lit("corpus/"), "source", F.lit(".log")).alias("location"), "source", "size", "events")
    path = I.scratch(spark, "provenance")
    sources.write_records(provenance.make_records(facts, "collector", "2024-01-01T00:00:00Z", F.col("source")), path)
    read = spark.read.text(path).select(F.col("value").alias("json"))

    def part(name: str) -> Column:
        return F.get_json_object("json", name)

    return read.select(
        part("$['data facts'].storage.location").alias("location"),
        part("$['data facts'].description").alias("description"),
        part("$['data facts'].metrics.size").cast("bigint").alias("size"),
        part("$['data facts'].metrics['event count']").cast("bigint").alias("events"),
        part("$.entry['processing type']").alias("processing_type"),
        part("$['data facts'].PII['may contain'][2]").alias("may_contain"),
    )
