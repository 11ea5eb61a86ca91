"""Whole-value predicates and the classifier built from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemesh.functions import patterns as P


def _matches(value: Column, pattern: str) -> Column:
    return value.rlike(P.spark_regex(pattern))


def is_timestamp_fragment(value: Column) -> Column:
    """Pieces of a timestamp that look like a dotted name, such as ``41.000Z``."""
    return reduce(
        lambda a, b: a | b,
        [value.endswith(ending) for ending in P.STAMP_ENDINGS],
        _matches(value, P.STAMP_FRAGMENT) | value.rlike(r"\A[0-9.]*\z"),
    )


# Each predicate asks for a needed character before it runs its pattern.


def is_address(value: Column) -> Column:
    return value.rlike(r"(?U)\A\d+\s") & _matches(value, P.ADDRESS)


def is_dnsname(value: Column) -> Column:
    bare = F.regexp_replace(value, r"[.\])]+\z", "")
    return value.contains(".") & _matches(bare, P.DNSNAME) & ~is_timestamp_fragment(bare)


def is_email(value: Column) -> Column:
    return value.contains("@") & _matches(value, P.EMAIL)


def is_ip(value: Column) -> Column:
    # Every branch of the second pattern holds two colons side by side, but for the first, which begins like this.
    colons = value.contains("::") | value.rlike(r"\A(?:[0-9a-fA-F]{1,4}:){7}")
    return (value.contains(".") & _matches(value, P.IPV4)) | (colons & _matches(value, P.IPV6))


def is_mac(value: Column) -> Column:
    return (F.length(value) == 17) & _matches(value, P.MAC)


def is_phonenumber(value: Column) -> Column:
    return ~_matches(value, P.DOTTED_QUAD) & _matches(value, P.PHONE)


def is_pid(value: Column) -> Column:
    return _matches(value, P.PID)


def _part_exceeds(value: Column, index: int, most: int) -> Column:
    """Whether the n-th dot-separated part is an unsigned 32-bit number above ``most``."""
    part = F.get(F.split(value, r"\."), F.lit(index))
    number = F.when(part.rlike(r"\A\+?[0-9]+\z"), part.try_cast("decimal(38,0)"))
    return F.coalesce((number > most) & (number < 2**32), F.lit(False))


def is_time(value: Column) -> Column:
    refused = (
        (value == "8.8.8")
        | value.contains("60")
        | value.startswith("54:")
        | (value.contains(".") & _part_exceeds(value, 0, 23))
        | _part_exceeds(value, 1, 59)
        | _part_exceeds(value, 2, 59)
    )
    return _matches(value, P.TIME) & ~refused


def is_tty(value: Column) -> Column:
    return _matches(value, P.TTY)


def is_url(value: Column) -> Column:
    return value.contains("://") & _matches(value, P.URL)


MATCHERS: dict[str, Callable[[Column], Column]] = {
    "address": is_address,
    "dnsname": is_dnsname,
    "email": is_email,
    "ip": is_ip,
    "mac": is_mac,
    "phonenumber": is_phonenumber,
    "pid": is_pid,
    "time": is_time,
    "tty": is_tty,
    "url": is_url,
}


def matcher(name: str) -> Callable[[Column], Column]:
    """The predicate registered under a category name."""
    return MATCHERS[name]


def _may_match(value: Column) -> Column:
    """Every category needs a digit or one of these marks, which most words do not have."""
    return value.rlike(r"(?U)[-.:@\d]")


def classify(value: Column) -> Column:
    """All category names a value belongs to, in fixed order; empty text has none."""
    labels = F.array_compact(F.array(*[F.when(test(value), F.lit(name)) for name, test in MATCHERS.items()]))
    return F.when(~_may_match(value), F.array().cast("array<string>")).otherwise(labels)


def is_any_match(value: Column) -> Column:
    return _may_match(value) & reduce(lambda a, b: a | b, [test(value) for test in MATCHERS.values()])
