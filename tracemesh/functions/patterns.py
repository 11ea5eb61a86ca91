"""Patterns and word lists shared by the extractors and predicates.

The strings are written in the common subset of RE2 and Java syntax, so the
same text can be used by Spark and by a SQL check.  :func:`spark_regex` adds
what Java needs to read them the same way: Unicode character classes, and
``$`` meaning the very end of the text (Java also accepts the position before
a final line break).
"""

# --- fixed values: whole-value patterns -----------------------------------
ADDRESS = r"^(?:\d+\s)(?:[A-Za-z0-9.-]+\s)+(?:Avenue|Lane|Road|Boulevard|Drive|Street|Ave|Dr|Rd|Blvd|Ln|St)\.?(?:\s[A-Za-z]+)?$"
DNSNAME = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}(?:\.[a-zA-Z]{2,})*$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
# '^' binds only the first branch and '$' only the last; kept because results depend on it.
IPV6 = r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}:|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,5}(?::[0-9a-fA-F]{1,4}){1,2}|(?:[0-9a-fA-F]{1,4}:){1,4}(?::[0-9a-fA-F]{1,4}){1,3}|(?:[0-9a-fA-F]{1,4}:){1,3}(?::[0-9a-fA-F]{1,4}){1,4}|(?:[0-9a-fA-F]{1,4}:){1,2}(?::[0-9a-fA-F]{1,4}){1,5}|[0-9a-fA-F]{1,4}:(?::[0-9a-fA-F]{1,4}){1,6}|:(?:(?::[0-9a-fA-F]{1,4}){1,7}|:)$"
MAC = r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"
PHONE = r"^(?:(?:\+\d{1,3}[-. ]?)?(?:\(\d{1,4}\)|\d{1,4})[-. ]?\d{1,4}[-. ]?\d{1,4}(?:[-. ]?\d{1,4})?|\d{3,7}|\+\d{1,3}[-. ]?\d{3,12})$"
DOTTED_QUAD = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
PID = r"^(?:\[)?(?:PID:?)?\s*\d{1,7}(?:\])?$"
TIME = r"^(?:(?:(?:[01]?\d|2[0-3])[:\.][0-5]\d(?:[:\.][0-5]\d)?(?:\s*[AP]M)?(?:\s+[A-Z]{3,4})?(?:[+-]\d{4})?)|(?:[01]\d|2[0-3])[0-5]\d|(?:\d{4}-\d{2}-\d{2}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,3})?(?:Z|[+-]\d{2}:?\d{2})?)|(?:\d{4}-\d{2}-\d{2}\s(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:,\d{3})?)|(?:T(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d)?Z)|(?:\d{10}))$"
TTY = r"^(?:/dev/)?(?:tty|pts|console|ttys|ttyS|ttyUSB|ttyACM)(?:\d+)$"
URL = r"^(?:https?|ftp)://(?:(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.)+[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d{1,5})?(?:/[^\s]*)?$"

# --- fixed values: patterns searched inside a line ------------------------
FIND_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
FIND_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
FIND_MAC_SEPARATED = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"
FIND_MAC_BARE = r"[^0-9A-Za-z]([0-9a-f]{12})[^0-9A-Za-z]"
FIND_DNSNAME = r"(?:(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)"
FIND_PHONE = r"\b(?:\+\d{1,3}[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}\b"
FIND_PHONE_BARE = r"\b\d{10,12}\b"
FIND_PID = r"\b(?:PID|pid)(?::|\s+)(\d{1,7})\b"
FIND_PID_BRACKETED = r"\[(?:PID:?)?\s*(\d{1,7})\]"
FIND_CLOCK = r"\b(?:(?:[01]?\d|2[0-3])[:\.][0-5]\d(?:[:\.][0-5]\d)?(?:\s*[AP]M)?(?:\s+[A-Z]{3,4})?(?:[+-]\d{4})?)\b"
FIND_HHMM = r"\b(?:[01]\d|2[0-3])[0-5]\d\b"
FIND_ISO_TIME = r"\b\d{4}-\d{2}-\d{2}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,3})?(?:Z|[+-]\d{2}:?\d{2})?\b"
FIND_DATE_TIME = r"\b\d{4}-\d{2}-\d{2}\s(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:,\d{3})?\b"
FIND_UNIX_TIME = r"\b\d{10}\b"
FIND_TTY_PATH = r"\b(?:/dev/)?(?:tty|pts)/\d+\b"
FIND_TTY_REF = r"\b(?:tty|pts)[/:]\d+\b"
FIND_TTY_ASSIGNED = r"\btty=(\S+)\b"
FIND_URL = r"\bhttps?://(?:[-\w]+\.)+[\w]{2,}(?:/[%\w\.-]*)*(?:\?\S*)?\b"
FIND_URL_WWW = r"\bwww\.(?:[-\w]+\.)+[\w]{2,}(?:/[%\w\.-]*)*(?:\?\S*)?\b"
FIND_USER_INVALID = r"Invalid user (\S+) from"
FIND_USER_FAILED = r"Failed password for (?:invalid user )?(\S+) from"
FIND_USER_ACCEPTED = r"Accepted (?:password|publickey) for (\S+) from"
FIND_USER_PLAIN = r"User (\S+) from"
FIND_JSON_HOST = r'"host"\s*:\s*"([^"]+)"'
FIND_STAMP_ISO = r"(\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)"
FIND_STAMP_SYSLOG = r"((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"

# --- fixed values: word lists ---------------------------------------------
STAMP_FRAGMENT = r"\d+\.\d+Z"
STAMP_ENDINGS = (".000Z", ".000", ".00Z", ".0Z")
SKIPPED_LITERALS = ("null", "true", "false")
CATEGORIES = ("address", "dnsname", "email", "ip", "mac", "phonenumber", "pid", "time", "tty", "url")
ENTRY_TYPES = ("Email", "IP", "DNSName", "URL", "Username", "TTY")
PERSONAL_TYPES = ("IP", "MAC", "Username", "Email", "Hostname", "URL", "DNSname", "TTY")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def spark_regex(pattern: str) -> str:
    """The same pattern with Unicode classes and a strict end-of-text anchor."""
    return "(?U)" + pattern.replace("$", r"\z")
