"""SQL for DuckDB that gives the same rows as the registered queries."""

from __future__ import annotations

from tracemesh.functions import patterns as P
from tracemesh.functions.labels import CAPTION, KEY_PREFIX
from tracemesh.operators.provenance import PROCESSING_TYPES, REMOVAL_POLICIES, SANITATION_LEVELS

ORACLE: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- inputs ---------------------------------------------------------------------

EV = """ev AS (
  SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)"""

EVENT_LOG = (
    EV
    + """,
heads AS (SELECT *, strftime(ts, '%b %d %H:%M:%S') || ' host' || k || ' sshd[' || user_id || ']: ' AS head,
  '10.0.' || user_id || '.' || k AS address FROM ev),
event_log AS (SELECT event_id AS line, CASE
  WHEN event_type = 'error' THEN head || 'Failed password for invalid user u' || user_id || ' from ' || address || ' port ' || (k + 20000)
  WHEN event_type = 'click' THEN head || 'Accepted publickey for u' || user_id || ' from ' || address || ' tty=pts/' || k
    || ' mac 02:00:5e:10:' || lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || ':' || lpad(CAST(k % 100 AS VARCHAR), 2, '0')
  WHEN event_type = 'view' THEN head || 'GET http://www.site' || k || '.example.com/u' || user_id || '?k=' || k || ' {"host": "host' || k
    || '.example.org"} at ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z'
  WHEN event_type = 'signup' AND k % 2 = 0 THEN (user_id + 100) || ' Main Street'
  WHEN event_type = 'signup' THEN head || 'User u' || user_id || '@mail' || k || '.example.org from pts/' || k || ' PID:' || user_id
    || ' call +1 555-010-' || lpad(CAST(k AS VARCHAR), 4, '0')
  ELSE head || 'Invalid user u' || user_id || ' from ' || address || ' at ' || CAST(floor(epoch(ts)) AS BIGINT) || ' on '
    || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' mac 02005e10' || lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') || ' .'
  END AS text FROM heads)"""
)

ALL_TEXT = (
    EVENT_LOG
    + """,
all_text AS (
  SELECT 'log' AS src, line AS id, text FROM event_log
  UNION ALL SELECT 'doc', doc_id, text FROM documents
  UNION ALL SELECT 'url', page_id, url FROM pages
  UNION ALL SELECT 'html', page_id, html FROM pages
  UNION ALL SELECT 'chat', conv_id, text FROM conversations)"""
)

TEXT_LINES = (
    ALL_TEXT
    + """,
pieces AS (SELECT src, id, string_split(text, chr(10)) AS parts FROM all_text),
text_lines AS (SELECT src, id, CAST(line AS BIGINT) AS line, parts[line] AS text
  FROM (SELECT src, id, parts, unnest(range(1, len(parts) + 1)) AS line FROM pieces))"""
)

VALUES = (
    ALL_TEXT
    + """,
vals AS (SELECT DISTINCT value FROM (
  SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS value FROM all_text
  UNION ALL SELECT text FROM event_log UNION ALL SELECT '/dev/pts' || k FROM ev))"""
)


# --- extractors -------------------------------------------------------------------


def _all(pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all(text, {_q(pattern)}, {group})"


def _fragment(value: str) -> str:
    endings = " OR ".join(f"ends_with({value}, {_q(e)})" for e in P.STAMP_ENDINGS)
    return f"(regexp_matches({value}, {_q(P.STAMP_FRAGMENT)}) OR regexp_full_match({value}, '[0-9.]*') OR {endings})"


_EMAIL_PIECES = f"string_split_regex(text, {_q(P.FIND_EMAIL)})"
_SPANS = f"""list_transform(range(1, len({_all(P.FIND_EMAIL)}) + 1), lambda i: struct_pack(
  s := coalesce(list_sum(list_transform({_EMAIL_PIECES}[1:i], lambda p: length(p))), 0)
     + coalesce(list_sum(list_transform({_all(P.FIND_EMAIL)}[1:i - 1], lambda p: length(p))), 0) + 1,
  n := length({_all(P.FIND_EMAIL)}[i])))"""
_USERS = ", ".join(
    f"nullif(regexp_extract(text, {_q(p)}, 1), '')"
    for p in (P.FIND_USER_INVALID, P.FIND_USER_FAILED, P.FIND_USER_ACCEPTED, P.FIND_USER_PLAIN)
)


def _concat(*lists: str) -> str:
    out = lists[0]
    for item in lists[1:]:
        out = f"list_concat({out}, {item})"
    return out


LISTS = {
    "ip": _all(P.FIND_IP),
    "mac": _concat(_all(P.FIND_MAC_SEPARATED), _all(P.FIND_MAC_BARE, 1)),
    "dnsname": f"""CASE WHEN contains(text, '@') THEN
  (SELECT coalesce(list(d ORDER BY n), []) FROM (SELECT d, min(n) AS n FROM (
     SELECT unnest({_all(P.FIND_DNSNAME)}) AS d, generate_subscripts({_all(P.FIND_DNSNAME)}, 1) AS n) GROUP BY d) x
   WHERE NOT {_fragment('d')} AND len(list_filter({_SPANS}, lambda e: e.s <= strpos(text, d) AND strpos(text, d) + length(d) <= e.s + e.n)) = 0)
  ELSE list_filter(list_distinct({_all(P.FIND_DNSNAME)}), lambda d: NOT {_fragment('d')}) END""",
    "email": _all(P.FIND_EMAIL),
    "phonenumber": _concat(
        _all(P.FIND_PHONE),
        f"list_filter({_all(P.FIND_PHONE_BARE)}, lambda x: NOT contains(text, ':' || x) AND NOT contains(text, '.' || x))",
    ),
    "pid": _concat(_all(P.FIND_PID, 1), _all(P.FIND_PID_BRACKETED, 1)),
    "time": _concat(
        f"list_filter({_all(P.FIND_CLOCK)}, lambda x: NOT (x = '8.8.8' OR contains(x, '60') OR starts_with(x, '54:')))",
        f"list_filter({_all(P.FIND_HHMM)}, lambda x: NOT contains(text, '-' || x || '-') AND NOT contains(text, '/' || x || '/'))",
        _all(P.FIND_ISO_TIME),
        _all(P.FIND_DATE_TIME),
        _all(P.FIND_UNIX_TIME),
    ),
    "tty": _concat(
        _all(P.FIND_TTY_PATH), _all(P.FIND_TTY_REF), f"list_transform({_all(P.FIND_TTY_ASSIGNED, 1)}, lambda x: 'tty=' || x)"
    ),
    "url": _concat(_all(P.FIND_URL), _all(P.FIND_URL_WWW)),
    "address": f"CASE WHEN regexp_matches(text, {_q(P.ADDRESS)}) THEN [text] ELSE [] END",
    "username": _concat(f"list_filter([{_USERS}], lambda x: x IS NOT NULL)", _all(P.FIND_JSON_HOST, 1)),
}
for _name, _list in LISTS.items():
    ORACLE[f"extract_{_name}"] = f"WITH {ALL_TEXT} SELECT src, id, unnest({_list}) AS value FROM all_text"


# --- predicates -------------------------------------------------------------------


def _is(pattern: str, value: str = "value") -> str:
    return f"regexp_matches({value}, {_q(pattern)})"


def _part(index: int, most: int) -> str:
    part = f"string_split(value, '.')[{index}]"
    return f"coalesce(regexp_full_match({part}, '[0-9]+') AND TRY_CAST({part} AS BIGINT) BETWEEN {most + 1} AND 4294967295, false)"


_BARE = r"regexp_replace(value, '[.\])]+$', '')"
TESTS = {
    "address": _is(P.ADDRESS),
    "dnsname": f"({_is(P.DNSNAME, _BARE)} AND NOT {_fragment(_BARE)})",
    "email": _is(P.EMAIL),
    "ip": f"({_is(P.IPV4)} OR {_is(P.IPV6)})",
    "mac": _is(P.MAC),
    "phonenumber": f"(NOT {_is(P.DOTTED_QUAD)} AND {_is(P.PHONE)})",
    "pid": _is(P.PID),
    "time": f"(NOT (value = '8.8.8' OR contains(value, '60') OR starts_with(value, '54:') OR (contains(value, '.') AND {_part(1, 23)})"
    f" OR {_part(2, 59)} OR {_part(3, 59)}) AND {_is(P.TIME)})",
    "tty": _is(P.TTY),
    "url": _is(P.URL),
}
for _name, _test in TESTS.items():
    ORACLE[f"is_{_name}"] = f"WITH {VALUES} SELECT value FROM vals WHERE {_test}"
_ANY = " OR ".join(TESTS.values())
ORACLE["is_any_match"] = f"WITH {VALUES} SELECT value FROM vals WHERE value <> '' AND ({_ANY})"
_NAMED = ", ".join(f"CASE WHEN {TESTS[name]} THEN '{name}' END" for name in sorted(TESTS))
ORACLE["matcher"] = f"""WITH {VALUES}, m AS (SELECT value, list_filter([{_NAMED}], lambda x: x IS NOT NULL) AS n FROM vals)
SELECT value, array_to_string(n, ',') AS names FROM m WHERE len(n) > 0"""
ORACLE["is_timestamp_fragment"] = f"WITH {VALUES} SELECT value FROM vals WHERE {_fragment('value')}"


def _labels(names=P.CATEGORIES) -> str:
    cases = ", ".join(f"CASE WHEN {TESTS[n]} THEN '{n}' END" for n in names)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


ORACLE["classify_values"] = f"""WITH {VALUES}, c AS (SELECT value, {_labels()} AS c FROM vals WHERE value <> '')
SELECT value, array_to_string(c, ',') AS categories FROM c WHERE len(c) > 0"""
ORACLE["line_timestamp"] = f"""WITH {TEXT_LINES}, s AS (SELECT src, id, line, coalesce(
  nullif(regexp_extract(text, {_q(P.FIND_STAMP_ISO)}, 1), ''), regexp_extract(text, {_q(P.FIND_STAMP_SYSLOG)}, 1)) AS stamp FROM text_lines)
SELECT * FROM s WHERE stamp <> ''"""


# --- scans ---------------------------------------------------------------------------

_SCAN_ORDER = ("ip", "mac", "dnsname", "email", "phonenumber", "pid", "time", "tty", "url", "address")


def _classified(extractors, exclude=(), include=()) -> str:
    found = _concat(*[LISTS[n] for n in extractors])
    wanted = f" AND list_has_any(c, {list(include)})" if include else ""
    return f"""{TEXT_LINES},
found AS (SELECT src, id, line, unnest({found}) AS value FROM text_lines),
kept AS (SELECT * FROM found WHERE strlen(value) >= 3 AND value NOT IN ('null', 'true', 'false')),
words AS (SELECT DISTINCT value FROM kept),
named AS (SELECT value, {_labels([n for n in P.CATEGORIES if n not in exclude])} AS c FROM words),
classified AS (SELECT src, id, line, value, c FROM kept JOIN named USING (value) WHERE len(c) > 0{wanted})"""


_FULL = _classified(_SCAN_ORDER)
_LINE_ROWS = "SELECT src, id, line, value, array_to_string(c, ',') AS categories FROM classified"
ORACLE["classify_lines"] = f"WITH {_FULL} {_LINE_ROWS}"
ORACLE["classify_lines_filtered"] = (
    "WITH "
    + _classified([n for n in _SCAN_ORDER if n not in ("pid", "phonenumber")], ("pid", "phonenumber"), ("ip", "email", "time"))
    + " "
    + _LINE_ROWS
)


def _share(source: str) -> str:
    return f"SELECT category, count(*) AS cnt, round(count(*) / sum(count(*)) OVER () * 100) AS percentage FROM {source} GROUP BY category"


_EXPLODED = "(SELECT unnest(c) AS category FROM classified)"
ORACLE["category_stats"] = f"WITH {_FULL} {_share(_EXPLODED)}"
ORACLE["scan_stats_basic"] = f"WITH {_classified(('ip', 'email', 'phonenumber'))} {_share(_EXPLODED)}"
ORACLE["run_summary"] = f"""WITH {_FULL} SELECT 'all' AS source, (SELECT count(*) FROM text_lines) AS total_lines_processed,
  (SELECT CAST(sum(len(c)) AS BIGINT) FROM classified) AS total_classifications"""


def _tagged(kinds: dict[str, str], table: str, columns: str, name: str) -> str:
    parts = [f"SELECT {columns}, '{label}' AS {name}, unnest({LISTS[key]}) AS value FROM {table}" for label, key in kinds.items()]
    return " UNION ALL ".join(parts)


_STAMP = f"""coalesce(nullif(regexp_extract(text, {_q(P.FIND_STAMP_ISO)}, 1), ''), regexp_extract(text, {_q(P.FIND_STAMP_SYSLOG)}, 1)) AS timestamp"""
_ENTRY_KINDS = {"Email": "email", "IP": "ip", "DNSName": "dnsname", "URL": "url", "Username": "username", "TTY": "tty"}
_FINDING_KINDS = {"email": "email", "ip": "ip", "url": "url", "dns_name": "dnsname"}
ORACLE["extract_entries"] = f"WITH {TEXT_LINES} {_tagged(_ENTRY_KINDS, 'text_lines', f'src, id, line, {_STAMP}', 'type')}"
ORACLE["scan_findings"] = f"WITH {TEXT_LINES} {_tagged(_FINDING_KINDS, 'text_lines', 'src, id, line', 'category')}"
_NO_URL = {k: v for k, v in _FINDING_KINDS.items() if k != "url"}
ORACLE["scan_findings_stats"] = (
    f"WITH {TEXT_LINES}, f AS ({_tagged(_NO_URL, 'text_lines', 'src, id, line', 'category')}) {_share('f')}"
)
_RANKED = " UNION ALL ".join(
    f"SELECT src, id, line, {rank} AS r, generate_subscripts(l, 1) AS n, '{label}' AS category, unnest(l) AS value"
    f" FROM (SELECT src, id, line, {LISTS[key]} AS l FROM text_lines)"
    for rank, (label, key) in enumerate(_FINDING_KINDS.items())
)
ORACLE["findings_sample"] = f"""WITH {TEXT_LINES}, f AS ({_RANKED})
SELECT src, id, line, category, value FROM (SELECT * FROM f ORDER BY src, id, line, r, n LIMIT 25)"""
ORACLE["limit_and_sample"] = f"WITH {TEXT_LINES} SELECT src, id, line, length(text) AS chars FROM text_lines WHERE line <= 20 AND line % 2 = 0"


# --- entries -------------------------------------------------------------------------------

ENTRIES = (
    EV
    + """,
entries AS (
  SELECT event_id AS line, pos, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
    (['Username', 'IP', 'Event', 'Hostname'])[pos + 1] AS type,
    CASE pos WHEN 0 THEN 'u' || user_id WHEN 1 THEN '10.0.' || user_id || '.' || k WHEN 2 THEN event_type ELSE 'host-' || k END AS value,
    user_id AS group_id
  FROM ev, (SELECT CAST(unnest(range(4)) AS BIGINT) AS pos))"""
)
ORDERS = """order_entries AS (
  SELECT l_orderkey AS line, 'part' AS type, 'p' || l_partkey AS value FROM lineitem
  UNION ALL SELECT l_orderkey, 'supp', 's' || l_suppkey FROM lineitem)"""

ORACLE["filter_types"] = f"WITH {ENTRIES} SELECT line, pos, type, value FROM entries WHERE type IN ('Username', 'IP')"
ORACLE["value_frequency"] = f"WITH {ORDERS} SELECT type, value, count(*) AS cnt FROM order_entries GROUP BY type, value"
ORACLE["distinct_lines"] = f"WITH {ORDERS} SELECT count(DISTINCT line) AS lines FROM order_entries"
ORACLE["frequency_report"] = f"""WITH {ORDERS} SELECT type, value, count(*) AS cnt,
  count(*) / (SELECT count(DISTINCT line) FROM order_entries) * 100 AS share
FROM order_entries GROUP BY type, value ORDER BY cnt DESC, type, value LIMIT 10"""


def _qualifying(table: str, types: str, percent: float, greedy: bool = True) -> str:
    return f"""qualifying AS (SELECT type, value, count(*) AS cnt FROM {table} WHERE type IN ({types}) GROUP BY type, value
  HAVING count(*) BETWEEN 2 AND floor({percent} / 100.0 * (SELECT count(DISTINCT line) FROM {table})))"""


ORACLE["qualifying_values"] = f"WITH {ORDERS}, {_qualifying('order_entries', _q('part'), 0.2)} SELECT * FROM qualifying"
ORACLE["value_lines"] = f"WITH {ORDERS} SELECT type, value, line, count(*) AS cnt FROM order_entries GROUP BY ALL"


def _greedy(types: str, percent: float) -> str:
    return f"""WITH RECURSIVE {ENTRIES}, {_qualifying('entries', types, percent)},
kept AS (SELECT line, pos, type || ':' || value AS v,
    lag(type || ':' || value) OVER (PARTITION BY line ORDER BY pos) AS before
  FROM entries SEMI JOIN qualifying USING (type, value)),
vals AS (SELECT v, min(line * 10 + pos) AS born, arg_min(coalesce(before, ''), line * 10 + pos) AS parent FROM kept GROUP BY v),
walk AS (SELECT v, born AS start FROM vals WHERE parent = ''
  UNION ALL SELECT vals.v, walk.start FROM vals JOIN walk ON vals.parent = walk.v),
line_start AS (SELECT line, start FROM (SELECT line, arg_max(v, pos) AS v FROM kept GROUP BY line) JOIN walk USING (v)),
numbered AS (SELECT line, dense_rank() OVER (ORDER BY start) AS identity FROM line_start)
SELECT line, type, value, identity FROM entries LEFT JOIN numbered USING (line)"""


ORACLE["identities_greedy"] = _greedy("'Username', 'IP', 'Hostname'", 10.0)
ORACLE["identities_greedy_rare"] = _greedy("'IP', 'Hostname'", 0.9)


def _labels_of(edges: str, nodes: str) -> str:
    """Smallest node of each component by spreading minimums."""
    return f"""links AS (SELECT a, b FROM ({edges}) UNION SELECT b, a FROM ({edges})),
cc(id, comp) USING KEY (id) AS (
  SELECT id, id FROM ({nodes})
  UNION
  SELECT u.id, min(v.comp) FROM recurring.cc AS u JOIN links ON links.a = u.id JOIN cc AS v ON v.id = links.b
  WHERE v.comp < u.comp GROUP BY u.id)"""


PART_IDENTITIES = f"""RECURSIVE {ORDERS}, {_qualifying('order_entries', _q('part'), 0.15)},
on_line AS (SELECT DISTINCT value, line FROM order_entries SEMI JOIN qualifying USING (type, value)),
starts AS (SELECT value, min(line) AS a FROM on_line GROUP BY value),
{_labels_of('SELECT a, line AS b FROM on_line JOIN starts USING (value) WHERE a <> line', 'SELECT DISTINCT line AS id FROM order_entries')},
ids AS (SELECT id AS line, dense_rank() OVER (ORDER BY comp) AS identity FROM cc),
tagged AS (SELECT line, type, value, identity FROM order_entries JOIN ids USING (line))"""
ORACLE["identities_components"] = f"WITH {PART_IDENTITIES} SELECT line, identity FROM ids"
ORACLE["kept_identities"] = f"WITH {PART_IDENTITIES} SELECT id AS line, comp AS start FROM cc"
ORACLE["search_identity_orders"] = f"""WITH {PART_IDENTITIES}
SELECT line, type, value, 'Identity_' || identity AS identity FROM tagged WHERE identity = (SELECT min(identity) FROM tagged WHERE value = 'p7')"""

# Addresses alone link the events of one (user, host) pair, so a component is an address.
IP_IDENTITIES = (
    ENTRIES
    + """,
ips AS (SELECT line, value FROM entries WHERE type = 'IP'),
counts AS (SELECT value, count(*) AS n, min(line) AS first FROM ips GROUP BY value),
start AS (SELECT line, CASE WHEN n BETWEEN 2 AND floor(10 / 100.0 * (SELECT count(DISTINCT line) FROM entries)) THEN first ELSE line END AS s
  FROM ips JOIN counts USING (value)),
tagged AS (SELECT e.line, e.pos, e.timestamp, e.type, e.value, dense_rank() OVER (ORDER BY s) AS identity FROM entries e JOIN start USING (line))"""
)
_SUMMARY = """l AS (SELECT identity, count(*) AS entries, count(DISTINCT line) AS lines, list_sort(list_distinct(list(line))) AS ll,
  list_sort(list_distinct(list(type || ':' || value))) AS vl FROM tagged GROUP BY identity)
SELECT identity, entries, lines, len(vl) AS distinct_values,
  CASE WHEN lines <= 5 THEN array_to_string(ll, ', ') ELSE lines || ' unique lines' END AS line_list,
  array_to_string(vl[1:3], ', ') || CASE WHEN len(vl) > 3 THEN ' (+ ' || (len(vl) - 3) || ' more)' ELSE '' END AS samples FROM l"""
ORACLE["identity_summary"] = f"WITH {IP_IDENTITIES}, {_SUMMARY}"
ORACLE["identity_summary_orders"] = f"WITH {PART_IDENTITIES}, {_SUMMARY}"
ORACLE["search_identity"] = f"""WITH {IP_IDENTITIES}
SELECT line, pos, timestamp, type, value, 'Identity_' || identity AS identity FROM tagged
WHERE identity = (SELECT min(identity) FROM tagged WHERE value = '10.0.8.69' HAVING count(*) <= 1000)"""
ORACLE["search_outcome"] = f"""WITH {IP_IDENTITIES}, h AS (SELECT count(*) AS cnt, min(identity) AS i FROM tagged WHERE value = 'click')
SELECT 'Event:click' AS value, cnt, CASE WHEN cnt = 0 THEN 'not found' WHEN cnt > 100 THEN 'too frequent' ELSE 'found' END AS outcome,
  CASE WHEN cnt BETWEEN 1 AND 100 THEN i END AS identity FROM h"""
ORACLE["trace_identity"] = f"""WITH {IP_IDENTITIES}
SELECT line, timestamp, type, value, 'Identity_1' AS identity FROM tagged WHERE identity = 1"""


# --- sessions --------------------------------------------------------------------------------

_MICROS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _sessions(gap_ms: int, keys: str = "") -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    return f"""{EV}, marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {gap_ms * 1000 + 999}
  THEN 1 ELSE 0 END AS begins FROM ev WINDOW w AS ({by}ORDER BY ts)),
numbered AS (SELECT *, sum(begins) OVER ({by}ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM marked),
sessions AS (SELECT *, min(ts) OVER (PARTITION BY {keys + ', ' if keys else ''}n) AS session FROM numbered)"""


ORACLE["gap_sessions"] = f"WITH {_sessions(120_000)} SELECT event_id AS row_number, {_MICROS.format('session')} AS session FROM sessions"
ORACLE["gap_sessions_per_user"] = f"""WITH {_sessions(21_600_000, 'user_id')} SELECT user_id, {_MICROS.format('min(ts)')} AS start,
  {_MICROS.format('max(ts)')} AS "end", count(*) AS rows FROM sessions GROUP BY user_id, n"""
ORACLE["session_collect"] = f"""WITH {_sessions(120_000)} SELECT {_MICROS.format('session')} AS session, event_type AS type,
  arg_max('u' || user_id, (ts, event_id)) AS value FROM sessions GROUP BY session, event_type"""
ORACLE["stream_collect_per_user"] = f"""WITH {_sessions(21_600_000, 'user_id')}, ranged AS (SELECT *, max(ts) OVER (PARTITION BY user_id, n) AS last FROM sessions)
SELECT user_id, {_MICROS.format('session')} AS session, event_type AS type, arg_max('u' || user_id, (ts, event_id)) AS value FROM ranged
WHERE epoch_us(last) + 21600000999 <= (SELECT epoch_ms(max(ts)) - 86400000 FROM ev) * 1000 GROUP BY user_id, session, event_type"""
_SESSION_ROWS = f"""WITH {_sessions(300_000)}"""
ORACLE["read_idrows"] = f"""{_SESSION_ROWS} SELECT {_MICROS.format('min(ts)')} AS start, {_MICROS.format('max(ts)')} AS "end",
  count(*) AS rows FROM sessions GROUP BY n"""
ORACLE["session_files"] = f"""{_SESSION_ROWS} SELECT count(*) AS rows, count(*) AS listed, min(event_id) AS first_row,
  count(DISTINCT event_type) AS types FROM sessions GROUP BY n"""


# --- nodes and groups --------------------------------------------------------------------------


def _key(type_: str = "type", value: str = "value") -> str:
    cases = " ".join(f"WHEN '{name}' THEN '{prefix}'" for name, prefix in KEY_PREFIX.items())
    return f"(CASE {type_} {cases} ELSE {type_} END || '_' || regexp_replace({value}, '[^A-Za-z0-9]+', '_', 'g'))"


ROUTED = (
    ENTRIES
    + f""",
routed AS (SELECT line, pos, timestamp, type, value, CASE WHEN type IN ('Username', 'IP') THEN 'node' ELSE 'filtered' END AS route,
  CASE WHEN type IN ('Username', 'IP') THEN {_key()} END AS node FROM entries),
nodes AS (SELECT * FROM routed WHERE route = 'node')"""
)
# A user and the addresses of that user: a line links the two, so a group is a user.
GROUPS = (
    ROUTED
    + """,
owners AS (SELECT user_id, dense_rank() OVER (ORDER BY min(event_id)) AS group_id FROM ev GROUP BY user_id),
members AS (SELECT DISTINCT node, group_id FROM nodes JOIN ev ON event_id = line JOIN owners USING (user_id)),
grouped AS (SELECT nodes.*, group_id FROM nodes JOIN ev ON event_id = line JOIN owners USING (user_id)),
links AS (SELECT src, dst, min(line) AS line FROM (SELECT a.node AS src, b.node AS dst, a.line FROM nodes a JOIN nodes b ON a.line = b.line
  WHERE a.pos = 0 AND b.pos = 1) GROUP BY src, dst),
log AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY links.line) AS step, src, dst, links.line,
  'u' || user_id AS a_value, arg AS b_value FROM links JOIN ev ON event_id = links.line JOIN owners USING (user_id)
  JOIN (SELECT node AS dst, min(value) AS arg FROM nodes GROUP BY node) USING (dst))"""
)

ORACLE["route_entries"] = f"""WITH {ENTRIES}, r AS (SELECT line, pos, type, value,
  CASE WHEN type IN ('Username', 'IP') OR value = 'signup' THEN 'node' ELSE 'filtered' END AS route FROM entries)
SELECT *, CASE WHEN route = 'node' THEN {_key()} END AS node FROM r"""
ORACLE["time_range"] = f"""WITH {ENTRIES} SELECT line, pos, timestamp FROM entries
WHERE CAST(timestamp AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'"""
_CAPTIONS = " ".join(f"WHEN '{name}' THEN '{text}'" for name, text in CAPTION.items())
ORACLE["node_labels"] = f"""WITH {TEXT_LINES}, e AS ({_tagged(_ENTRY_KINDS, 'text_lines', 'line', 'type')}),
d AS (SELECT DISTINCT type, value, CASE type WHEN 'DNSName' THEN 'DNSname' ELSE type END AS t FROM e)
SELECT type, value, regexp_replace(value, '[^A-Za-z0-9]+', '_', 'g') AS clean,
  {_key('t')} || '([' || CASE t {_CAPTIONS} ELSE t END || '<br/>'
    || replace(replace(CASE WHEN t = 'URL' THEN split_part(value, '?', 1) ELSE value END, '@', '_AT_'), '[', '_') || '])' AS label,
  CASE WHEN starts_with(value, 'http') THEN split_part(value, '?', 1) ELSE value END AS shown, t || ':' || value AS vkey FROM d"""
ORACLE["line_links"] = f"""WITH {GROUPS} SELECT src, dst, line, CAST(0 AS BIGINT) AS pos_a, CAST(1 AS BIGINT) AS pos_b FROM links"""
ORACLE["person_groups"] = f"WITH {GROUPS} SELECT node, group_id FROM members"
_ALL_NODES = f"""all_nodes AS (SELECT line, pos, {_key()} AS node FROM entries WHERE type <> 'Event')"""
ORACLE["person_groups_all_types"] = f"""WITH RECURSIVE {ENTRIES}, {_ALL_NODES},
stars AS (SELECT DISTINCT a.node AS a, b.node AS b FROM all_nodes a JOIN all_nodes b ON a.line = b.line AND a.pos = 0 AND b.pos > 0),
{_labels_of('SELECT a, b FROM stars', 'SELECT DISTINCT node AS id FROM all_nodes')},
firsts AS (SELECT comp, min(line) AS f FROM cc JOIN all_nodes ON node = id GROUP BY comp)
SELECT id AS node, dense_rank() OVER (ORDER BY f) AS group_id FROM cc JOIN firsts USING (comp)"""
ORACLE["singleton_groups"] = f"""WITH {ENTRIES}, h AS (SELECT DISTINCT {_key()} AS node FROM entries WHERE type = 'Hostname')
SELECT node, row_number() OVER (ORDER BY node) AS group_id FROM h"""
ORACLE["merge_log"] = f"""WITH {GROUPS} SELECT group_id, step, CASE WHEN step = 1 THEN 'FORMED' ELSE 'ADDED' END AS event, a_value, b_value,
  CASE WHEN step > 1 THEN dst END AS new_member, line FROM log"""
ORACLE["formation_graph"] = f"""WITH {GROUPS} SELECT group_id, step - 1 AS from_step, step AS to_step, a_value AS via_a, b_value AS via_b
FROM log WHERE step > 1"""

# Nets of one day, replayed link by link, all days in lockstep.  A node carries the number of the link that last
# changed its group, so that number tells the step before, and the last one the group.
DAYS = f"""RECURSIVE {EV}, seen AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM ev),
entries AS (SELECT event_id AS line, CAST(0 AS BIGINT) AS pos, timestamp, day, 'Username' AS type,
    CASE WHEN k % 7 = 0 THEN 'lone' || user_id % 5 ELSE 'u' || user_id % 12 END || '@' || day AS value FROM seen
  UNION ALL SELECT event_id, 1, timestamp, day, 'Hostname', 'host-' || user_id % 3 || '-' || k % 5 || '@' || day FROM seen WHERE k % 7 <> 0),
nodes AS (SELECT *, {_key()} AS node FROM entries),
links AS (SELECT day, a.node AS src, b.node AS dst, min(a.line) AS line FROM nodes a JOIN nodes b USING (line, day) WHERE a.pos = 0 AND b.pos = 1 GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY line) AS rn FROM links),
ends AS (SELECT DISTINCT day, unnest([src, dst]) AS node FROM links),
state(step, day, node, comp) AS (
  SELECT CAST(0 AS BIGINT), day, node, CAST(NULL AS BIGINT) FROM ends
  UNION ALL
  SELECT l.rn, s.day, s.node, CASE WHEN a.comp = b.comp THEN s.comp WHEN s.node IN (l.src, l.dst) OR s.comp IN (a.comp, b.comp) THEN l.rn ELSE s.comp END
  FROM state s JOIN numbered l ON l.day = s.day AND l.rn = s.step + 1 JOIN state a ON a.day = s.day AND a.node = l.src JOIN state b ON b.day = s.day AND b.node = l.dst),
changes AS (SELECT l.*, a.comp AS ca, b.comp AS cb FROM numbered l JOIN state a ON a.day = l.day AND a.step = l.rn - 1 AND a.node = l.src
  JOIN state b ON b.day = l.day AND b.step = l.rn - 1 AND b.node = l.dst WHERE a.comp IS DISTINCT FROM b.comp OR a.comp IS NULL),
final AS (SELECT day, node, comp FROM state WHERE (day, step) IN (SELECT (day, max(rn)) FROM numbered GROUP BY day)),
numbers AS (SELECT day, comp, dense_rank() OVER (ORDER BY min(line)) AS group_id FROM final JOIN links USING (day) WHERE src = node GROUP BY day, comp),
members AS (SELECT node, group_id FROM final JOIN numbers USING (day, comp)),
shown AS (SELECT node, min(value) AS value FROM nodes GROUP BY node),
log AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY c.line) AS step, c.*, x.value AS a_value, y.value AS b_value,
  CASE WHEN ca IS NULL AND cb IS NULL THEN 'FORMED' WHEN ca IS NULL OR cb IS NULL THEN 'ADDED' ELSE 'MERGED' END AS event,
  CASE WHEN ca IS NULL AND cb IS NOT NULL THEN src WHEN cb IS NULL AND ca IS NOT NULL THEN dst END AS new_member
  FROM changes c JOIN members ON node = src JOIN shown x ON x.node = src JOIN shown y ON y.node = dst)"""
ORACLE["person_groups_days"] = f"WITH {DAYS} SELECT node, group_id FROM members"
ORACLE["merge_log_days"] = f"WITH {DAYS} SELECT group_id, step, event, a_value, b_value, new_member, line FROM log"
ORACLE["formation_nodes_days"] = ORACLE["merge_log_days"]
ORACLE["formation_graph_days"] = f"""WITH {DAYS} SELECT l.group_id, p.step AS from_step, l.step AS to_step, l.a_value AS via_a, l.b_value AS via_b
FROM log l JOIN log p ON p.day = l.day AND p.rn IN (l.ca, l.cb)"""
ORACLE["singleton_groups_days"] = f"""WITH {DAYS}, alone AS (SELECT DISTINCT node FROM nodes WHERE node NOT IN (SELECT node FROM members))
SELECT node, row_number() OVER (ORDER BY node) + (SELECT max(group_id) FROM members) AS group_id FROM alone"""
def _cover(entries: str) -> str:
    """The greedy cover line by line, all groups in lockstep, and the values of the chosen lines."""
    return f"""on_lines AS (SELECT group_id, line, list_distinct(list(value)) AS vals FROM {entries} GROUP BY ALL),
cover(group_id, missing, line) AS (
  SELECT group_id, list_distinct(list(value)), CAST(NULL AS BIGINT) FROM {entries} GROUP BY group_id
  UNION ALL
  SELECT group_id, list_filter(missing, lambda x: NOT list_contains(best.vals, x)), best.line FROM (
    SELECT c.group_id, any_value(c.missing) AS missing, arg_max({{'line': l.line, 'vals': l.vals}}, (len(list_intersect(l.vals, c.missing)), -l.line)) AS best
    FROM cover c JOIN on_lines l ON l.group_id = c.group_id WHERE len(c.missing) > 0 GROUP BY c.group_id))
SELECT group_id, line, value, any_value(first) AS timestamp
FROM (SELECT *, arg_min(timestamp, pos) OVER (PARTITION BY group_id, line) AS first FROM {entries}) SEMI JOIN cover USING (group_id, line)
GROUP BY group_id, line, value"""


ORACLE["line_cover"] = f"WITH RECURSIVE {ENTRIES}, {_cover('entries')}"
ORACLE["line_cover_days"] = f"WITH {DAYS}, grouped AS (SELECT * FROM nodes JOIN members USING (node)), {_cover('grouped')}"
ORACLE["tuple_provenance_days"] = f"""WITH {DAYS}, pairs AS (SELECT DISTINCT f.group_id, f.a_value, l.b_value FROM log l JOIN log f USING (group_id) WHERE f.step = 1),
own AS (SELECT value, arg_min((line, timestamp, type), (line, pos)) AS e FROM nodes GROUP BY value),
together AS (SELECT p.*, min(x.line) AS line FROM pairs p LEFT JOIN (SELECT a.line, a.value AS av, b.value AS bv FROM nodes a JOIN nodes b USING (line)) x
  ON x.av = a_value AND x.bv = b_value GROUP BY ALL),
sides AS (SELECT group_id, a_value, b_value, line, CAST(0 AS BIGINT) AS side, a_value AS value, b_value AS other FROM together
  UNION ALL SELECT group_id, a_value, b_value, line, 1, b_value, a_value FROM together)
SELECT s.group_id, a_value, b_value, side, s.value, coalesce(s.line, o.e[1]) AS line, coalesce(n.timestamp, o.e[2]) AS timestamp, coalesce(n.type, o.e[3]) AS type,
  coalesce(s.line, CASE WHEN o.e[1] = t.e[1] THEN o.e[1] END) AS tuple_line
FROM sides s JOIN own o ON o.value = s.value JOIN own t ON t.value = s.other LEFT JOIN nodes n ON n.line = s.line AND n.value = s.value"""
ORACLE["step_entries"] = f"""WITH {GROUPS}, f AS (SELECT value, min((line, pos)) AS p FROM grouped WHERE group_id = 1 GROUP BY value)
SELECT g.value AS shown, line, timestamp, type, g.value FROM grouped g JOIN f ON f.value = g.value AND f.p = (g.line, g.pos)"""
ORACLE["tuple_provenance"] = f"""WITH {GROUPS}, t AS (SELECT log.*, timestamp FROM log JOIN nodes USING (line) WHERE pos = 0)
SELECT group_id, a_value, b_value, CAST(0 AS BIGINT) AS side, a_value AS value, line, timestamp, 'Username' AS type, line AS tuple_line FROM t
UNION ALL SELECT group_id, a_value, b_value, 1, b_value, line, timestamp, 'IP', line FROM t"""
ORACLE["node_stats"] = f"""WITH {ROUTED} SELECT node, arg_min(type, (line, pos)) AS type, arg_min(value, (line, pos)) AS value, count(*) AS cnt,
  arg_min(timestamp, (line, pos)) AS first_seen, arg_max(timestamp, (line, pos)) AS last_seen FROM nodes GROUP BY node"""
ORACLE["technical_counts"] = f"""WITH {ROUTED}, f AS (SELECT line, count(*) AS n FROM routed WHERE route = 'filtered' GROUP BY line)
SELECT node, CAST(sum(n) AS BIGINT) AS filtered FROM nodes JOIN f USING (line) GROUP BY node"""
ORACLE["technical_entries"] = f"""WITH {ROUTED} SELECT r.line, r.pos, r.timestamp, r.type, r.value, CAST(2 AS BIGINT) AS times
FROM routed r JOIN ev ON event_id = line WHERE user_id = 8 AND route = 'filtered'"""
_GROUP_COUNTS = """g AS (SELECT group_id, count(*) * 3 AS cnt, count(DISTINCT node) AS members, count(DISTINCT (value, type)) AS nodes,
  arg_min(timestamp, (line, pos)) AS first_seen, arg_max(timestamp, (line, pos)) AS last_seen FROM grouped GROUP BY group_id)"""
ORACLE["group_stats"] = f"WITH {GROUPS}, {_GROUP_COUNTS} SELECT group_id, members, cnt, first_seen, last_seen FROM g"
ORACLE["group_summary"] = f"WITH {GROUPS}, {_GROUP_COUNTS} SELECT group_id, cnt, nodes, first_seen, last_seen FROM g"
ORACLE["node_line_values"] = f"WITH {GROUPS} SELECT DISTINCT group_id, line, value FROM grouped"
ORACLE["node_last_entries"] = f"""WITH {GROUPS} SELECT group_id, value, max(line) AS line, arg_max(timestamp, (line, pos)) AS timestamp,
  arg_max(type, (line, pos)) AS type FROM grouped GROUP BY group_id, value"""
ORACLE["exclusion_catalogue"] = f"WITH {ROUTED} SELECT DISTINCT value FROM routed WHERE route = 'filtered' UNION SELECT 'signup'"


# --- activity and search --------------------------------------------------------------------------

TIMED = (
    ENTRIES
    + f""",
timed AS (SELECT *, CAST(timestamp AS TIMESTAMP) AS seen, {_key()} AS node FROM entries)"""
)
ORACLE["activity_per_hour"] = f"""WITH {TIMED} SELECT group_id, {_MICROS.format("date_trunc('hour', seen)")} AS hour, count(*) AS cnt
FROM timed GROUP BY ALL"""
ORACLE["activity_per_value"] = f"WITH {TIMED} SELECT group_id, value AS key, count(*) AS cnt, min(line) AS line FROM timed GROUP BY group_id, value"
ORACLE["activity_summary"] = f"""WITH {TIMED}, s AS (SELECT group_id, count(*) AS total_entries, count(DISTINCT node) AS unique_entries,
  min(seen) AS lo, max(seen) AS hi, epoch_us(max(seen)) - epoch_us(min(seen)) AS us FROM timed GROUP BY group_id)
SELECT group_id, total_entries, unique_entries, {_MICROS.format('lo')} AS min_at, {_MICROS.format('hi')} AS max_at,
  us // 86400000000 AS duration_days, us / 3600000000 AS duration_hours FROM s"""
ORACLE["heatmap_segments"] = f"""WITH {TIMED},
r AS (SELECT group_id, epoch_us(min(seen)) AS lo, epoch_us(max(seen)) - epoch_us(min(seen)) AS us FROM timed GROUP BY group_id),
n AS (SELECT *, CASE WHEN us < 3600000000 THEN 60 WHEN us < 86400000000 THEN 120 WHEN us < 604800000000 THEN 168 ELSE 200 END AS n FROM r),
p AS (SELECT *, us // n + CASE WHEN (us % n) * 2 > n OR ((us % n) * 2 = n AND (us // n) % 2 = 1) THEN 1 ELSE 0 END AS step FROM n),
grid AS (SELECT group_id, lo, n, step, CAST(unnest(range(n)) AS BIGINT) AS segment FROM p),
c AS (SELECT g.group_id, g.segment, count(t.seen) AS cnt FROM grid g LEFT JOIN timed t ON t.group_id = g.group_id
  AND epoch_us(t.seen) >= g.lo + g.step * g.segment AND epoch_us(t.seen) < g.lo + g.step * (g.segment + 1) GROUP BY ALL)
SELECT group_id, segment, {_MICROS.format('make_timestamp(lo + step * segment)')} AS start,
  {_MICROS.format('make_timestamp(lo + step * (segment + 1))')} AS "end", cnt, segment / n * 100 AS percentage, 'Unknown' AS dominant_type,
  CASE WHEN cnt = 0 THEN 'none' WHEN cnt <= 10 THEN 'low' WHEN cnt <= 30 THEN 'medium' WHEN cnt <= 50 THEN 'high' ELSE 'extreme' END AS activity_level
FROM grid JOIN c USING (group_id, segment)"""


def _top(kind: str, key: str, text: str, k: int, share: str) -> str:
    return f"""SELECT group_id, '{kind}' AS kind, CAST(rank AS INTEGER) AS rank, {text} AS key, cnt, {share} AS percentage FROM (
  SELECT group_id, {key} AS x, count(*) AS cnt, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, min((line, pos))) AS rank
  FROM timed GROUP BY group_id, x) JOIN totals USING (group_id) WHERE rank <= {k}"""


ORACLE["heatmap_statistics"] = f"""WITH {TIMED}, totals AS (SELECT group_id, count(*) AS total FROM timed GROUP BY group_id)
{_top('hour', "date_trunc('hour', seen)", "strftime(x, '%Y-%m-%d %H:00')", 3, 'CAST(NULL AS DOUBLE)')} UNION ALL
{_top('day', "date_trunc('day', seen)", "strftime(x, '%Y-%m-%d')", 3, 'NULL')} UNION ALL
{_top('value', 'value', 'x', 5, 'round(cnt / total * 100, 1)')}"""
ORACLE["heatmap_averages"] = f"""WITH {TIMED}, s AS (SELECT group_id, count(*) AS total_entries, count(DISTINCT node) AS unique_entries,
  count(DISTINCT date_trunc('hour', seen)) AS active_hours, count(DISTINCT date_trunc('day', seen)) AS active_days FROM timed GROUP BY group_id)
SELECT *, round(total_entries / active_hours, 1) AS avg_hour, round(total_entries / active_days, 1) AS avg_day FROM s"""
ORACLE["heatmap_slice"] = f"""WITH {TIMED} SELECT group_id, line, timestamp, type, value FROM timed
WHERE seen >= TIMESTAMP '2024-01-03' AND seen < TIMESTAMP '2024-01-04 12:00:00'"""
ORACLE["first_type_per_value"] = f"WITH {TIMED} SELECT group_id, value, arg_min(type, (line, pos)) AS type FROM timed GROUP BY group_id, value"

ORACLE["search_value"] = f"""WITH {GROUPS}, hit AS (SELECT * FROM grouped WHERE contains(lower(value), 'u12'))
SELECT DISTINCT node AS node_id, type || ': ' || value AS display_text, 'primary' AS match_type FROM hit
UNION ALL SELECT DISTINCT 'ID_' || group_id, 'ID_' || group_id || ' (part of group)', 'entry' FROM hit"""
ORACLE["search_filtered"] = f"""WITH {GROUPS}, hit AS (SELECT g.* FROM grouped g JOIN ev ON event_id = line WHERE event_type = 'purchase'),
sizes AS (SELECT group_id, count(*) AS n FROM members GROUP BY group_id)
SELECT DISTINCT node AS node_id, type || ': ' || value || ' (found in filtered entries)' AS display_text, 'filtered' AS match_type FROM hit
UNION ALL SELECT DISTINCT 'ID_' || group_id, 'Group: ' || n || ' entries (found in filtered entries)', 'filtered' FROM hit JOIN sizes USING (group_id)"""
ORACLE["search_time"] = f"""WITH {GROUPS}, hit AS (SELECT * FROM grouped WHERE contains(timestamp, '2024-01-07 1'))
SELECT node AS node_id, any_value(type) || ': ' || any_value(value) || ' (Date match: ' || min(timestamp) || ')' AS display_text, 'entry' AS match_type
FROM hit GROUP BY node
UNION ALL SELECT DISTINCT 'ID_' || group_id, 'ID_' || group_id || ' (Match in group)', 'entry' FROM hit"""
ORACLE["search_value_and_time"] = f"""WITH {GROUPS}, own AS (SELECT DISTINCT node, type, value FROM grouped WHERE contains(lower(value), '10.0.8.')),
hit AS (SELECT * FROM grouped WHERE contains(value, '10.0.8.') AND contains(timestamp, '2024-01-07'))
SELECT node AS node_id, type || ': ' || value AS display_text, 'primary' AS match_type FROM own
UNION ALL SELECT 'ID_' || group_id, 'Group: ID_' || group_id || ' (Combined match: ' || arg_min(value, (line, pos)) || ' at '
  || arg_min(timestamp, (line, pos)) || ')', 'entry' FROM hit GROUP BY group_id"""


def _days_search(text: str | None, time: str | None = None) -> str:
    """Own values first, then the first entry in a group; nets of the days have no filtered entries."""
    value = f"contains(lower(value), '{text}')" if text else "true"
    at = f"contains(timestamp, '{time}')" if time else "true"
    own = f"SELECT DISTINCT node AS node_id, type || ': ' || value AS display_text, 'primary' AS match_type FROM nodes WHERE {value}"
    if not text:
        own = f"""SELECT node AS node_id, any_value(type) || ': ' || any_value(value) || ' (Date match: ' || min(timestamp) || ')' AS display_text,
          'entry' AS match_type FROM nodes WHERE {at} GROUP BY node"""
    shown = "'ID_' || group_id || ' (part of group)'"
    if not text:
        shown = "'ID_' || group_id || ' (Match in group)'"
    elif time:
        shown = "'Group: ID_' || group_id || ' (Combined match: ' || arg_min(lower(value), (line, pos)) || ' at ' || arg_min(timestamp, (line, pos)) || ')'"
    return f"""WITH {DAYS} {own} UNION ALL
    SELECT 'ID_' || group_id, {shown}, 'entry' FROM nodes JOIN members USING (node) WHERE {value} AND {at} GROUP BY group_id"""


ORACLE["search_index_value"] = _days_search("u1")
ORACLE["search_index_text"] = _days_search("host-1-")
ORACLE["search_index_text_and_time"] = _days_search("ost-2-4@2024", "01-1")
ORACLE["search_index_time"] = _days_search(None, "2024-01-07 1")
ORACLE["search_index_filtered"] = ORACLE["search_filtered"]
ORACLE["node_details"] = f"SELECT * FROM ({ORACLE['node_stats']}) WHERE node = 'User_u8'"
ORACLE["line_details"] = f"WITH {GROUPS} SELECT line, pos, timestamp, type, value FROM grouped WHERE line = 0"
ORACLE["kept_stoplist"] = """WITH k AS (SELECT DISTINCT event_type AS value FROM events), two AS (SELECT value FROM k WHERE value <> 'signup'
  UNION SELECT 'signup' WHERE 'signup' NOT IN (SELECT value FROM k))
SELECT 1::BIGINT AS version, value FROM k UNION ALL SELECT 2, value FROM two
UNION ALL SELECT 3, value FROM two WHERE value <> 'logout' UNION ALL SELECT 3, 'logout' WHERE 'logout' NOT IN (SELECT value FROM two)"""
ORACLE["stoplist_toggle"] = "SELECT DISTINCT event_type AS value FROM events WHERE event_type <> 'click' UNION SELECT 'logout'"


# --- templates -----------------------------------------------------------------------------------------

_FIELDS = [("Event", "event_type", True), ("k", "k", False), ("user", "user_id", False), ("when", "CAST(floor(epoch(ts)) AS BIGINT)", True)]


def _items(fields, rec: str, table: str) -> str:
    parts = []
    for n, (key, column, quoted) in enumerate(fields):
        parts.append(f"SELECT {rec} AS rec, {2 * n} AS idx, lower('\"{key}\"') AS text FROM {table}")
        text = f"lower('\"' || {column} || '\"')" if quoted else f"CAST({column} AS VARCHAR)"
        parts.append(f"SELECT {rec}, {2 * n + 1}, {text} FROM {table}")
    return " UNION ALL ".join(parts)


# The field "when" holds ten-digit seconds that start with 1: a time of its own.
ITEMS = f"""{EV}, raw AS ({_items(_FIELDS, 'event_id', 'ev')}),
items AS (SELECT rec, idx, CASE WHEN regexp_full_match(text, '"(2025.*|1.{{9}})"') THEN NULL ELSE text END AS text FROM raw),
dictionary AS (SELECT text AS token_text, 1000 + row_number() OVER (ORDER BY min((rec, idx))) AS token, count(*) AS cnt
  FROM items WHERE text IS NOT NULL GROUP BY text)"""
VECTORS = f"""{ITEMS}, vectors AS (SELECT rec AS vec_id, list(coalesce(token, 1) ORDER BY idx) AS vec
  FROM items LEFT JOIN dictionary ON token_text = text GROUP BY rec)"""
ORACLE["build_dictionary"] = f"WITH {ITEMS} SELECT * FROM dictionary"
_ORDER_FIELDS = [("priority", "o_orderpriority", True), ("status", "o_orderstatus", True), ("user", "o_custkey", False)]
ORACLE["dictionary_growth"] = f"""WITH {ITEMS}, second AS ({_items(_ORDER_FIELDS, 'o_orderkey', 'orders')}),
used AS (SELECT text AS token_text, min((rec, idx)) AS first, count(*) AS cnt FROM second GROUP BY text),
new AS (SELECT * FROM used ANTI JOIN dictionary USING (token_text))
SELECT token_text, (SELECT max(token) FROM dictionary) + row_number() OVER (ORDER BY first) AS token, cnt FROM new
UNION ALL SELECT d.token_text, d.token, coalesce(used.cnt, 0) FROM dictionary d LEFT JOIN used USING (token_text)"""
ORACLE["kept_dictionary"] = ORACLE["dictionary_growth"]
ORACLE["tokenise"] = f"WITH {VECTORS} SELECT vec_id, array_to_string(vec, ',') AS vec FROM vectors"
ORACLE["detokenise"] = f"""WITH {ITEMS} SELECT rec AS vec_id, CAST(idx // 2 AS BIGINT) AS field,
  max(CASE WHEN idx % 2 = 0 THEN text END) AS key, max(CASE WHEN idx % 2 = 1 THEN coalesce(text, '"timestamp"') END) AS value
FROM items GROUP BY rec, field"""
ORACLE["vector_lengths"] = f"WITH {VECTORS} SELECT CAST(len(vec) AS INTEGER) AS length, count(*) AS cnt FROM vectors GROUP BY length"
_CELLS = f"""{VECTORS}, d AS (SELECT min(vec_id) AS i, vec[2] AS e, vec[4] AS k, vec[6] AS u FROM vectors GROUP BY vec)"""
_TWO = "(a.e <> b.e)::INT + (a.k <> b.k)::INT + (a.u <> b.u)::INT = 2"
ORACLE["hamming_partners"] = f"WITH {_CELLS} SELECT a.i, min(b.i) AS j FROM d a JOIN d b ON {_TWO} GROUP BY a.i"
for _d in (1, 2, 3):
    ORACLE[f"hamming_links_{_d}"] = f"""WITH {VECTORS}, d AS (SELECT min(vec_id) AS i, count(*) AS copies, vec, vec[2] AS e, vec[4] AS k, vec[6] AS u FROM vectors GROUP BY vec),
    near AS (SELECT a.i, count(*) AS links FROM d a JOIN d b ON {_TWO[:-1]}{_d} GROUP BY a.i)
    SELECT vec_id, i, copies, coalesce(links, 0) AS links FROM vectors JOIN d USING (vec) LEFT JOIN near USING (i)"""

# One step of mining per recursion; the row -1 fits no rule and keeps the last step visible.
MINED = f"""RECURSIVE {_CELLS},
mined(step, i, e, k, u, ri, rj) AS (
  SELECT 0, i, e, k, u, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM d UNION ALL SELECT 0, -1, -1, -1, -1, NULL, NULL
  UNION ALL
  SELECT m.step + 1, m.i, m.e, m.k, m.u, a.i, b.i
  FROM mined m, (SELECT min((a.i, b.i)) AS pair FROM mined a JOIN mined b ON {_TWO} WHERE a.i >= 0 AND b.i > a.i) p
  JOIN mined a ON a.i = p.pair[1] JOIN mined b ON b.i = p.pair[2]
  WHERE m.i = -1 OR (a.e = b.e AND m.e <> a.e) OR (a.k = b.k AND m.k <> a.k) OR (a.u = b.u AND m.u <> a.u)),
rules AS (SELECT step AS rule_id, ri, rj FROM mined WHERE step > 0 AND i = -1)"""
ORACLE["rule_coverage"] = f"""WITH {MINED},
lost AS (SELECT i, max(step) + 1 AS rule_id FROM mined WHERE i >= 0 GROUP BY i),
copies AS (SELECT min(vec_id) AS i, count(*) AS n FROM vectors GROUP BY vec)
SELECT CAST(rule_id AS BIGINT) AS rule_id, CAST(sum(n) AS BIGINT) AS cnt FROM lost JOIN copies USING (i) JOIN rules USING (rule_id) GROUP BY rule_id"""
PAIRS = f"""{MINED}, pairs AS (SELECT rule_id, a.vec AS va, b.vec AS vb, ri, rj,
  list_filter(range(len(a.vec)), lambda x: a.vec[x + 1] <> b.vec[x + 1]) AS places
  FROM rules JOIN vectors a ON a.vec_id = ri JOIN vectors b ON b.vec_id = rj)"""
ORACLE["mine_rules"] = f"""WITH {PAIRS}
SELECT CAST(rule_id AS BIGINT) AS rule_id, ri AS i, rj AS j, CAST(places[1] AS INTEGER) AS p, CAST(places[2] AS INTEGER) AS q,
  array_to_string(list_transform(range(len(va)), lambda x: CASE WHEN va[x + 1] = vb[x + 1] THEN va[x + 1] ELSE 0 END), ',') AS rule FROM pairs"""
ORACLE["rule_values"] = f"""WITH {PAIRS}, used AS (SELECT DISTINCT rule_id,
  unnest([va[places[1] + 1], va[places[2] + 1], vb[places[1] + 1], vb[places[2] + 1]]) AS token FROM pairs)
SELECT token, CAST(rule_id AS BIGINT) AS rule_id, count(*) OVER (PARTITION BY token) AS rules FROM used"""
ORACLE["match_rules"] = f"""WITH {PAIRS} SELECT v.vec_id, CAST(rule_id AS BIGINT) AS rule_id FROM vectors v JOIN pairs ON len(v.vec) = len(va)
  AND len(list_filter(range(len(va)), lambda x: va[x + 1] = vb[x + 1] AND va[x + 1] <> v.vec[x + 1])) = 0"""
ORACLE["retokenise"] = f"""WITH {PAIRS}, sides AS (SELECT rule_id * 2 AS vec_id, ri AS rec FROM pairs UNION ALL SELECT rule_id * 2 + 1, rj FROM pairs)
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(idx // 2 AS BIGINT) AS field,
  max(CASE WHEN idx % 2 = 0 THEN text END) AS key, max(CASE WHEN idx % 2 = 1 THEN coalesce(text, '"timestamp"') END) AS value
FROM sides JOIN items USING (rec) GROUP BY vec_id, field"""


# --- files and provenance ----------------------------------------------------------------------------------

_LINES = "len(string_split(text, chr(10)))"
ORACLE["read_log"] = f"""WITH c AS (SELECT lang, CAST(sum({_LINES}) AS BIGINT) AS n, CAST(sum(length(text) - {_LINES} + 1) AS BIGINT) AS chars
  FROM documents GROUP BY lang) SELECT lang, n AS lines, n AS last, n AS different, chars FROM c"""
ORACLE["count_events"] = f"SELECT lang, CAST(sum({_LINES}) AS BIGINT) AS events FROM documents GROUP BY lang"
ORACLE["estimate_lines"] = f"SELECT count(*) AS documents, CAST(sum({_LINES}) AS BIGINT) AS lines FROM documents"
ORACLE["line_estimates"] = f"SELECT lang, CAST(sum({_LINES}) AS BIGINT) AS lines, CAST(0 AS BIGINT) AS far, CAST(0 AS BIGINT) AS much_read FROM documents GROUP BY lang"
ORACLE["read_log_first_lines"] = f"""WITH {EVENT_LOG}, n AS (SELECT row_number() OVER (ORDER BY line) AS line, text FROM event_log)
SELECT line, text FROM n WHERE line <= 2500 AND line % 3 = 0"""
ORACLE["read_log_first_of_each"] = "SELECT CAST(40 AS BIGINT) AS lines, CAST(40 AS BIGINT) AS last, CAST(6 AS BIGINT) AS files"
ORACLE["read_entries"] = f"WITH {ENTRIES} SELECT line, timestamp, type, value FROM entries"
ORACLE["read_json_records"] = """SELECT count(*) AS records, count(*) AS last, count(*) AS different,
  CAST(sum(user_id) AS BIGINT) AS users FROM events"""
ORACLE["file_inventory"] = f"SELECT lang, CAST(sum({_LINES}) AS BIGINT) AS events, 0::BIGINT AS unreadable FROM documents GROUP BY lang"
ORACLE["read_stoplist"] = "SELECT n_name AS value FROM nation WHERE n_nationkey % 5 <> 0"
ORACLE["stats_file"] = f"""WITH {TEXT_LINES}, f AS ({_tagged(_FINDING_KINDS, 'text_lines', 'src, id, line', 'category')}), s AS ({_share('f')})
SELECT (SELECT count(*) FROM text_lines) AS total_lines_processed, (SELECT count(*) FROM f) AS total_classifications, * FROM s"""


def _in(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


_NUMBER = "CAST(CASE WHEN n_chars % 2 = 0 THEN n_chars + 0.5 ELSE n_chars END AS DOUBLE)"
_DAY = "lpad(CAST(doc_id % {} AS VARCHAR), 2, '0')"
ORACLE["validate_records"] = f"""WITH d AS (SELECT doc_id, source, CASE WHEN lang = 'en' THEN 'collection' ELSE lang END AS kind,
  '2024-01-' || {_DAY.format(40)} || 'T00:00:00Z' AS stamp, '2030-02-' || {_DAY.format(31)} AS deadline,
  CASE WHEN doc_id % 3 = 0 THEN 'keep' ELSE 'delete' END AS policy, CASE WHEN doc_id % 5 = 0 THEN 'clean' ELSE 'raw' END AS level,
  source || '@example.org' AS mail, n_chars FROM documents)
SELECT doc_id, 'entry/timestamp' AS path, 'date-time' AS rule, stamp AS value FROM d WHERE TRY_CAST(left(stamp, 10) AS DATE) IS NULL
UNION ALL SELECT doc_id, 'entry/processing type', 'enum', kind FROM d WHERE kind NOT IN {_in(PROCESSING_TYPES)}
UNION ALL SELECT doc_id, 'data facts/storage/retention/deadline', 'date', deadline FROM d WHERE TRY_CAST(deadline AS DATE) IS NULL
UNION ALL SELECT doc_id, 'data facts/storage/retention/removal policy', 'enum', policy FROM d WHERE policy NOT IN {_in(REMOVAL_POLICIES)}
UNION ALL SELECT doc_id, 'data facts/PII/sanitation', 'enum', level FROM d WHERE level NOT IN {_in(SANITATION_LEVELS)}
UNION ALL SELECT doc_id, 'data facts/rights/owner/contact email', 'email', mail FROM d WHERE NOT regexp_matches(mail, {_q(P.EMAIL)})
UNION ALL SELECT doc_id, 'data facts/metrics/size', 'integer', CAST({_NUMBER} AS VARCHAR) FROM d WHERE n_chars % 2 = 0"""
ORACLE["build_records_of_files"] = f"""SELECT lang, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size, CAST(sum({_LINES}) AS BIGINT) AS events
FROM documents GROUP BY lang"""
ORACLE["read_records"] = "SELECT source AS location, CAST(sum(n_chars) AS BIGINT) AS size, count(*) AS events FROM documents GROUP BY source"
ORACLE["build_records"] = f"""SELECT 'corpus/' || source || '.log' AS location,
  'Log file of ' || source || ': ' || source || '.log' AS description, CAST(sum(n_chars) AS BIGINT) AS size,
  CAST(sum({_LINES}) AS BIGINT) AS events, 'collection' AS processing_type, 'IP addresses' AS may_contain FROM documents GROUP BY source"""
