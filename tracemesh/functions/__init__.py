"""Column functions: extractors, predicates, labels and timestamps."""

from tracemesh.functions.extract import (  # noqa: F401
    EXTRACTORS,
    extract_addresses,
    extract_dnsnames,
    extract_emails,
    extract_ips,
    extract_macs,
    extract_phonenumbers,
    extract_pids,
    extract_times,
    extract_ttys,
    extract_urls,
    extract_usernames,
    line_timestamp,
)
from tracemesh.functions.labels import clean_id, node_key, node_label, normalise_type, strip_query, vkey  # noqa: F401
from tracemesh.functions.predicates import (  # noqa: F401
    MATCHERS,
    classify,
    is_address,
    is_any_match,
    is_dnsname,
    is_email,
    is_ip,
    is_mac,
    is_phonenumber,
    is_pid,
    is_time,
    is_timestamp_fragment,
    is_tty,
    is_url,
    matcher,
)
from tracemesh.functions.times import parse_bound, parse_instant, parse_ts  # noqa: F401
