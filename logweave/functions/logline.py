"""Syslog line parsing and template masking as Column expressions.

Line format: ``<PRI>VER TIMESTAMP HOST PROGRAM PID MSGID SD  MESSAGE``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for equal templates:
# hexadecimal addresses (lower-case digits only) become "mem_addr", then every
# run of decimal digits becomes "*"; the order of the two steps matters.
HEX_PATTERN = "0x[0-9a-f]+"
HEX_TOKEN = "mem_addr"
DIGIT_PATTERN = "[0-9]+"
DIGIT_TOKEN = "*"


def mask(line: Column | str) -> Column:
    """Template of a line: hex addresses, then digit runs, masked."""
    col = F.col(line) if isinstance(line, str) else line
    return F.regexp_replace(F.regexp_replace(col, HEX_PATTERN, HEX_TOKEN),
                            DIGIT_PATTERN, DIGIT_TOKEN)


def timestamp_of(ts_token: Column) -> Column:
    """Wall-clock time of the timestamp token, its UTC offset ignored.

    The token must begin with a full date and clock time; its first 19
    characters (``yyyy-MM-ddTHH:mm:ss``) are cast to TIMESTAMP_NTZ: no time zone
    takes part, and anything shorter or out of range gives null.
    """
    full = ts_token.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}")
    return F.when(full, F.substring(ts_token, 1, 19).try_cast("timestamp_ntz"))


def epoch_seconds(ts_ntz: Column) -> Column:
    """Seconds since 1970-01-01 of a TIMESTAMP_NTZ, from its date and clock fields.

    No time zone takes part (``timestamp_diff`` would convert through the
    session zone and shift by an hour across daylight-saving changes).
    """
    days = F.datediff(F.to_date(ts_ntz), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts_ntz) * 3600 + F.minute(ts_ntz) * 60 + F.second(ts_ntz)


def priority(first_token: Column) -> Column:
    return F.regexp_extract(first_token, r"^<([0-9]+)>", 1).try_cast("int")


def message(line: Column | str) -> Column:
    """Text after the seventh token (the structured-data field) and its blanks."""
    col = F.col(line) if isinstance(line, str) else line
    return F.regexp_extract(col, r"^\s*(?:\S+\s+){7}(.*)$", 1)
