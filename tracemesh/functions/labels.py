"""Node keys, labels and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: prefixes and captions per type --------------------------
KEY_PREFIX = {
    "IP": "IPv4",
    "DNSname": "DNS",
    "MAC": "MAC",
    "Username": "User",
    "Email": "Email",
    "Hostname": "Hostname",
    "TTY": "TTY",
    "URL": "URL",
    "Example": "Example",
    "Example2": "Example2",
}
CAPTION = {"IP": "IP-Address", "MAC": "MAC-Address", "Username": "User"}
TYPE_SPELLING = {"DNSName": "DNSname", "MAC-osoite": "MAC"}


def _lookup(value: Column, table: dict[str, str], otherwise: Column) -> Column:
    found = otherwise
    for key, name in table.items():
        found = F.when(value == key, F.lit(name)).otherwise(found)
    return found


def clean_id(value: Column) -> Column:
    """Everything but ASCII letters, digits and ``_`` becomes one ``_`` per run."""
    return F.regexp_replace(value, "[^A-Za-z0-9]+", "_")


def strip_query(value: Column, type_: Column | None = None) -> Column:
    """A web address without its query.  What counts as one: the type if given, else an ``http`` start."""
    is_address = value.startswith("http") if type_ is None else type_ == "URL"
    return F.when(is_address, F.substring_index(value, "?", 1)).otherwise(value)


def vkey(type_: Column, value: Column) -> Column:
    """The composite ``type:value`` key."""
    return F.concat(type_, F.lit(":"), value)


def normalise_type(type_: Column) -> Column:
    """One spelling per type, so that extracted names reach the grouping step."""
    return _lookup(type_, TYPE_SPELLING, type_)


def node_key(type_: Column, value: Column) -> Column:
    """Identifier of the node an entry belongs to."""
    return F.concat(_lookup(type_, KEY_PREFIX, type_), F.lit("_"), clean_id(value))


def node_label(type_: Column, value: Column) -> Column:
    """Key plus the text shown for it; a URL is shown without its query."""
    shown = F.when(type_ == "URL", F.substring_index(value, "?", 1)).otherwise(value)
    shown = F.replace(F.replace(shown, F.lit("@"), F.lit("_AT_")), F.lit("["), F.lit("_"))
    caption = _lookup(type_, CAPTION, type_)
    return F.concat(node_key(type_, value), F.lit("(["), caption, F.lit("<br/>"), shown, F.lit("])"))
