"""Readers and writers."""

from tracemesh.sources.inventory import file_inventory, list_files  # noqa: F401
from tracemesh.sources.logs import count_events, estimate_lines, line_estimates, read_log  # noqa: F401
from tracemesh.sources.sinks import (  # noqa: F401
    write_dictionary,
    write_entries,
    write_records,
    write_sessions,
    write_stats,
)
from tracemesh.sources.tables import (  # noqa: F401
    read_dictionary,
    read_entries,
    read_idrows,
    read_json_records,
    read_records,
    read_stoplist,
    read_vectors,
)
