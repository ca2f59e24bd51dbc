"""Scalar rules for raw request records, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields that make up a record's identity, and those it must have, in the order they are looked at.
TRACKED = ("unique_key", "created_date", "closed_date", "agency", "agency_name", "complaint_type", "descriptor", "status", "borough", "community_board", "resolution_action_updated_date", "open_data_channel_type")
REQUIRED = ("unique_key", "created_date", "complaint_type", "borough")
REASONS = (*[f"missing {f}" for f in REQUIRED], "unparseable created_date", "non-numeric unique_key")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def missing(c: Column) -> Column:
    """Null or the empty string; blanks alone are not missing."""
    return c.isNull() | (c == "")


def parse_wall_clock(c: Column) -> Column:
    """Local time without a zone: an ISO date or date-time, with or without a final Z; null for blank, ``N/A`` or anything else.

    An offset such as +05:00 is dropped and the wall clock kept."""
    text = F.regexp_replace(strip(c), "Z$", "")
    return F.when(missing(c) | (c == "N/A") | ~text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(None)).otherwise(text).try_cast("timestamp_ntz")


def local_day(c: Column) -> Column:
    """The day of a wall clock; no step through another zone."""
    return F.to_date(c)


def request_number(c: Column) -> Column:
    """An id as long; null where it is not a whole number. Unlike Python's int, ``1_0`` is not one."""
    return F.when(strip(c).rlike(r"^[+-]?\d+$"), strip(c)).try_cast("bigint")


def tracked_payload(*fields: str) -> Column:
    """Canonical JSON of the fields that are not null, in order of their names."""
    return F.to_json(F.struct(*sorted(fields or TRACKED)))


def payload_hash(*fields: str) -> Column:
    """SHA-256 of the canonical JSON; neither the order of fields nor untracked ones matter."""
    return F.sha2(tracked_payload(*fields), 256)


def title(c: Column) -> Column:
    """Each word with a capital."""
    return F.initcap(F.lower(c))


def reject_reason(bad_time: Column, bad_number: Column) -> Column:
    """The first rule that a raw record breaks, or null."""
    out = F.lit(None).cast("string")
    rules = [*[missing(F.col(f)) for f in REQUIRED], bad_time, bad_number]
    for broken, reason in reversed(list(zip(rules, REASONS, strict=True))):
        out = F.when(broken, F.lit(reason)).otherwise(out)
    return out


def row_digest(*columns: str) -> Column:
    """A hash of a row's values, null included."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns]))
