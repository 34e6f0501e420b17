"""Dates and ages as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweft.functions.binding import let
from newsweft.functions.text import non_blank, strip

RETENTION_HOURS = 24 * 60

# Zone names of RFC 2822 and their fixed offsets.
ZONE_OFFSETS = {
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}

_MAIL = (
    r"\A(?:[A-Za-z]{3},?\s+)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+(\d{2}:\d{2})(:\d{2})?(?:\s+(\S+))?\z"
)
_ISO = r"\A(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(\.\d+)?(Z|z|[+-]\d{2}:\d{2})?\z"
_COMPACT = r"\A\d{8}T\d{6}Z\z"


def parse_date(c: Column) -> Column:
    """RFC 2822, RFC 3339, compact and naive dates, read as UTC; null when none fits."""
    return let(strip(c), _parse)


def _groups(raw: Column, pattern: str, n: int) -> Column:
    """All groups of a pattern that fits the whole text, by one match; empty for a group that is not there."""
    return F.split(F.regexp_replace(raw, pattern, "\u0001".join(f"${i}" for i in range(1, n + 1))), "\u0001", -1)


def _mail_text(groups: Column) -> Column:
    day, month, year, minutes, seconds, zone = (F.get(groups, F.lit(i)) for i in range(6))
    named = reduce(lambda acc, kv: acc.when(zone == kv[0], F.lit(kv[1])), ZONE_OFFSETS.items(), F.when(F.rlike(zone, F.lit(r"\A[+-]\d{4}\z")), zone))
    offset = named.otherwise(F.lit("+0000"))  # GMT, UT, no zone and names nobody defined
    return F.concat_ws(" ", day, F.initcap(month), year, F.concat(minutes, F.when(seconds == "", F.lit(":00")).otherwise(seconds)), offset)


def _parse(raw: Column) -> Column:
    mail = let(_groups(raw, _MAIL, 6), _mail_text)
    iso_zone = F.upper(F.regexp_extract(raw, _ISO, 4))
    iso = F.concat(
        F.regexp_extract(raw, _ISO, 1),
        F.lit("T"),
        F.regexp_extract(raw, _ISO, 2),
        F.regexp_extract(raw, _ISO, 3),
        F.when(iso_zone == "", F.lit("Z")).otherwise(iso_zone),
    )
    return (
        F.when(F.rlike(raw, F.lit(_MAIL)), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")))
        .when(F.rlike(raw, F.lit(_ISO)), iso.try_cast("timestamp"))
        .when(F.rlike(raw, F.lit(_COMPACT)), F.try_to_timestamp(raw, F.lit("yyyyMMdd'T'HHmmss'Z'")))
    )


def first_date(now: Column, *candidates: Column) -> Column:
    """Parse the first non-blank candidate; fall back to ``now``."""
    return F.coalesce(parse_date(F.coalesce(*[non_blank(c) for c in candidates])), now)


def whole_hours(later: Column, earlier: Column) -> Column:
    """Whole hours from ``earlier`` to ``later``, truncated towards zero."""
    return F.timestamp_diff("HOUR", earlier, later)


def whole_minutes(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MINUTE", earlier, later)


def is_stale(last_update: Column, now: Column, hours: int = RETENTION_HOURS) -> Column:
    """True when the last update is more than ``hours`` old (exact, not truncated)."""
    return now > last_update + F.expr(f"INTERVAL {int(hours)} HOURS")


def ago(now: Column, then: Column) -> Column:
    """Compact age: 5s, 7m, 3h, 2d; ``now`` for the future."""
    s = F.timestamp_diff("SECOND", then, now)

    def whole(unit: int, mark: str) -> Column:
        return F.concat(F.floor(s / unit).cast("string"), F.lit(mark))

    return (
        F.when(s < 0, F.lit("now"))
        .when(s < 60, whole(1, "s"))
        .when(s < 3600, whole(60, "m"))
        .when(s < 86400, whole(3600, "h"))
        .otherwise(whole(86400, "d"))
    )
