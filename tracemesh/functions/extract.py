"""Extractors: text column in, array-of-strings column out.

Each extractor first asks a cheap question about the line (is there an ``@``
at all?) so that the backtracking pattern runs only on lines that can match.
Inside a line, a look at the next characters keeps the pattern from being
tried where it cannot begin; a Unicode word boundary costs far more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemesh.functions import patterns as P
from tracemesh.functions.predicates import is_address, is_timestamp_fragment

_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def _find(text: Column, pattern: str, group: int = 0, ahead: str = "") -> Column:
    """All matches.  ``ahead`` is what any match must begin with, and changes no result."""
    return F.regexp_extract_all(text, F.lit(P.spark_regex(ahead + pattern)), group)


def _when(possible: Column, found: Column) -> Column:
    return F.when(possible, found).otherwise(_empty())


def extract_emails(text: Column) -> Column:
    # A match begins where a run of name characters begins, or where the last match ended:
    # elsewhere in the run the rest of the text, and so the outcome, is the same.
    begin = r"(?:\G|(?<![a-zA-Z0-9._%+-]))"
    return _when(text.contains("@"), _find(text, P.FIND_EMAIL, ahead=begin))


def extract_ips(text: Column) -> Column:
    return _when(text.rlike(r"(?U)\.\d{1,3}\."), _find(text, P.FIND_IP, ahead=r"(?=\d{1,3}\.\d)"))


def extract_macs(text: Column) -> Column:
    separated = _when(text.rlike("[:-][0-9A-Fa-f]{2}[:-]"), _find(text, P.FIND_MAC_SEPARATED, ahead="(?=[0-9A-Fa-f]{2}[:-])"))
    # Java is slow at a class of all but some characters, so twelve digits are asked for first.
    bare = _when(text.rlike("(?<![0-9A-Za-z])[0-9a-f]{12}(?![0-9A-Za-z])"), _find(text, P.FIND_MAC_BARE, 1, ahead="(?=(?s:.)[0-9a-f]{12})"))
    return F.concat(separated, bare)


def _email_spans(text: Column) -> Column:
    """Start and end of every e-mail match; matches are ordered, so each is looked up after the last."""
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))

    def step(acc: Column, email: Column) -> Column:
        at = F.position(email, text, acc["next"])
        end = at + F.length(email)
        span = F.array(F.struct(at.alias("s"), end.alias("e")))
        return F.struct(end.alias("next"), F.concat(acc["spans"], span).alias("spans"))

    return F.aggregate(extract_emails(text), start, step, lambda acc: acc["spans"])


def extract_dnsnames(text: Column) -> Column:
    """Dotted names, without parts of e-mail addresses and timestamp fragments, each once."""

    def outside(spans: Column, name: Column) -> Column:
        at = F.position(name, text)
        return ~F.exists(spans, lambda span: (span["s"] <= at) & (at + F.length(name) <= span["e"]))

    found = _find(text, P.FIND_DNSNAME, ahead=r"(?=[a-zA-Z0-9-]{1,63}+\.[a-zA-Z0-9])")
    # The one-element array makes Spark work out the spans once per line, not once per name.
    kept = F.transform(F.array(_email_spans(text)), lambda spans: F.filter(found, lambda name: outside(spans, name)))
    names = F.when(text.contains("@"), F.flatten(kept)).otherwise(found)
    names = F.filter(names, lambda name: ~is_timestamp_fragment(name))
    return _when(text.rlike(r"\.[a-zA-Z0-9]"), F.array_distinct(names))


def extract_phonenumbers(text: Column) -> Column:
    """Grouped numbers, then bare runs of 10 to 12 digits; a bare 10-digit run is in both."""
    bare = F.filter(
        _find(text, P.FIND_PHONE_BARE, ahead=r"(?=\d{10})"),
        lambda number: ~(text.contains(F.concat(F.lit(":"), number)) | text.contains(F.concat(F.lit("."), number))),
    )
    return _when(text.rlike(r"(?U)\d{4}"), F.concat(_find(text, P.FIND_PHONE, ahead=r"(?=[+(\d])"), bare))


def extract_pids(text: Column) -> Column:
    named = _when(text.contains("PID") | text.contains("pid"), _find(text, P.FIND_PID, 1, ahead="(?=PID|pid)"))
    bracketed = _when(text.contains("["), _find(text, P.FIND_PID_BRACKETED, 1))
    return F.concat(named, bracketed)


def extract_times(text: Column) -> Column:
    """Clock times, HHMM, ISO stamps, date-times and 10-digit seconds, one pass after the other."""
    clock = F.filter(
        _find(text, P.FIND_CLOCK, ahead=r"(?=\d{1,2}[:.])"),
        lambda found: ~((found == "8.8.8") | found.contains("60") | found.startswith("54:")),
    )
    hhmm = F.filter(
        _find(text, P.FIND_HHMM, ahead=r"(?=\d{4})"),
        lambda found: ~(
            text.contains(F.concat(F.lit("-"), found, F.lit("-"))) | text.contains(F.concat(F.lit("/"), found, F.lit("/")))
        ),
    )
    four = text.rlike(r"(?U)\d{4}")
    seconds = F.filter(_find(text, P.FIND_UNIX_TIME, ahead=r"(?=\d{10})"), lambda found: found.rlike(r"\A[0-9]+\z"))
    found = F.concat(
        _when(text.rlike(r"(?U)[:.][0-5]\d"), clock),
        _when(four, hhmm),
        _when(four & text.contains("T"), _find(text, P.FIND_ISO_TIME, ahead=r"(?=\d{4}-)")),
        _when(four & text.contains(":"), _find(text, P.FIND_DATE_TIME, ahead=r"(?=\d{4}-)")),
        _when(four, seconds),
    )
    return _when(text.rlike(r"(?U)\d\d"), found)


def extract_ttys(text: Column) -> Column:
    """Terminal paths, terminal mentions (overlapping the paths) and ``tty=`` assignments."""
    terminal = text.contains("tty") | text.contains("pts")
    assigned = F.transform(_find(text, P.FIND_TTY_ASSIGNED, 1, ahead="(?=tty=)"), lambda name: F.concat(F.lit("tty="), name))
    return _when(
        terminal,
        F.concat(
            _find(text, P.FIND_TTY_PATH, ahead="(?=/dev|tty/|pts/)"), _find(text, P.FIND_TTY_REF, ahead="(?=tty|pts)"), assigned
        ),
    )


def extract_urls(text: Column) -> Column:
    """Web addresses with a scheme, then ``www.`` hosts; one with both is found twice."""
    with_scheme = _when(text.contains("://"), _find(text, P.FIND_URL, ahead="(?=http)"))
    www = _when(text.contains("www."), _find(text, P.FIND_URL_WWW, ahead=r"(?=www\.)"))
    return F.concat(with_scheme, www)


def extract_addresses(text: Column) -> Column:
    """A text that is one street address as a whole."""
    return _when(is_address(text), F.array(text))


def extract_usernames(text: Column) -> Column:
    """The first user of each login phrase, then every JSON ``host`` value."""
    phrases = (P.FIND_USER_INVALID, P.FIND_USER_FAILED, P.FIND_USER_ACCEPTED, P.FIND_USER_PLAIN)
    first = [F.nullif(F.regexp_extract(text, P.spark_regex(phrase), 1), F.lit("")) for phrase in phrases]
    users = _when(text.contains(" from"), F.array_compact(F.array(*first)))
    hosts = _when(text.contains('"host"'), _find(text, P.FIND_JSON_HOST, 1))
    return F.concat(users, hosts)


def line_timestamp(text: Column) -> Column:
    """The first ISO-like stamp of a line, else the first syslog stamp, else an empty string."""
    iso = F.regexp_extract(text, P.spark_regex(r"(?=\d{4}-)" + P.FIND_STAMP_ISO), 1)
    syslog = F.regexp_extract(text, P.spark_regex("(?=[JFMASOND][a-z]{2})" + P.FIND_STAMP_SYSLOG), 1)
    iso = F.when(text.rlike(r"(?U)-\d{2}-\d"), iso).otherwise("")
    return F.when(~text.contains(":"), "").when(iso != "", iso).otherwise(syslog)


EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "ip": extract_ips,
    "mac": extract_macs,
    "dnsname": extract_dnsnames,
    "email": extract_emails,
    "phonenumber": extract_phonenumbers,
    "pid": extract_pids,
    "time": extract_times,
    "tty": extract_ttys,
    "url": extract_urls,
    "address": extract_addresses,
}
