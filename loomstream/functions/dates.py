"""Dates and times as column expressions; times are epoch milliseconds in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstream.functions.text import let

# The forms in which pages write dates, in the order they are tried: the pattern of the local part, and
# what the text looks like with that part in group 1 and a zone, if any, in group 2. A weekday in front is cut off before.
_ZONE = r" ?([A-Z]{1,4}|[+-]\d\d:?\d\d)?"
FORMATS = (
    ("yyyy-MM-dd'T'HH:mm:ss", r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)([+-]\d\d:\d\d|Z)"),
    ("MMMM d, yyyy, hh:mm a", r"^([A-Z][a-z]{2,8} \d{1,2}, \d{4}, \d\d:\d\d [AP]M)()"),
    ("MMMM d, yyyy", r"^([A-Z][a-z]{3,8} \d{1,2}, \d{4})()(?!  )"),
    ("yyyy-MM-dd'T'HH:mm", r"^(\d{4}-\d\d-\d\dT\d\d:\d\d)([+-]\d\d:?(?:\d\d)?|Z)"),
    ("yyyy-MM-dd", r"^(\d{4}-\d\d-\d\d)()"),
    ("yyyyMMddHHmmss", r"^(\d{14})()"),
    ("yyyyMMdd", r"^(\d{8})()"),
    ("yyyy/MM/dd HH:mm:ss", r"^(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d)()"),
    ("yyyy/M/d", r"^(\d{4}/\d{1,2}/\d{1,2})()"),
    ("d MMM yyyy HH:mm:ss", rf"^(\d{{1,2}} [A-Z][a-z]{{2}} \d{{4}} \d\d:\d\d:\d\d){_ZONE}"),
    ("d MMM yyyy HH:mm", rf"^(\d{{1,2}} [A-Z][a-z]{{2}} \d{{4}} \d\d:\d\d){_ZONE}"),
    ("d MMM yyyy 'at' hha", rf"^(\d{{1,2}} [A-Z][a-z]{{2}} \d{{4}} at \d\d[AP]M){_ZONE}"),
    ("d MMM yyyy '|' HH:mm", rf"^(\d{{1,2}} [A-Z][a-z]{{2}} \d{{4}} \| \d\d:\d\d){_ZONE}"),
    ("d MMM yyyy", r"^(\d{1,2} [A-Z][a-z]{2} \d{4})()(?![ |])"),
    ("MM.dd.yyyy", r"^(\d\d\.\d\d\.\d{4})()"),
    ("d MMMM yyyy", r"^(\d{1,2} [A-Z][a-z]{2,8} \d{4})()"),
    ("hh:mm a MMMM d, yyyy", r"^(\d\d:\d\d [AP]M) ([A-Z]{1,4}) ( *[A-Z][a-z]{2,8} \d{1,2}, \d{4})"),
    ("MMM d, yyyy h:mm a", r"^([A-Z][a-z]{2} \d{1,2}, \d{4} +\d{1,2}:\d\d [AP]M)()"),
    ("MMM d yyyy, HH:mm", rf"^([A-Z][a-z]{{2}} \d{{1,2}} \d{{4}}, \d\d:\d\d){_ZONE}"),
    ("MMM d HH:mm:ss yyyy", r"^([A-Z][a-z]{2} \d{1,2} \d\d:\d\d:\d\d) ([A-Z]{1,4}) (\d{4})"),
    ("MMM d yyyy", r"^([A-Z][a-z]{2} \d{1,2} \d{4})()"),
    ("MMM d, yyyy", r"^([A-Z][a-z]{2} \d{1,2}, \d{4})()"),
)
#: Minutes before UTC of the zones that pages name (public abbreviations).
ZONES = {"Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": -60, "CET": -60, "CEST": -120, "EET": -120, "EEST": -180, "MSK": -180, "IST": -330, "JST": -540, "AEST": -600,
         "AEDT": -660, "EST": 300, "EDT": 240, "CST": 360, "CDT": 300, "MST": 420, "MDT": 360, "PST": 480, "PDT": 420, "AKST": 540, "AKDT": 480, "HST": 600}
# The days and months that URLs hold.
DAY_IN_URL = (
    r"/((?:18|19|20)[0-9]{2}/[01]?[0-9]/[0-3]?[0-9])/",
    r"/((?:18|19|20)[0-9]{2}-[01]?[0-9]-[0-3]?[0-9])[/-]",
    r"/((?:18|19|20)[0-9]{2}[01][0-9][0-3][0-9])/",
    r"-((?:18|19|20)[0-9]{2}[01][0-9][0-3][0-9])$",
)
MONTH_IN_URL = r"/(20[0-9]{2}/(?:0[0-9]|1[012]))/"


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a local time taken as UTC, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def zone_minutes(zone: Column) -> Column:
    """Minutes to add to a local time to get UTC: of a name or ±HH, ±HHMM, ±HH:MM; 0 for an empty zone, null for an unknown name."""
    digits = F.rpad(F.regexp_replace(zone, "[^0-9]", ""), 4, "0")
    named = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])[zone]
    numeric = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    return F.when(zone == "", 0).when(zone.startswith("+"), -numeric).when(zone.startswith("-"), numeric).otherwise(named)


def parse_date_time(c: Column) -> Column:
    """Epoch milliseconds of a date in any known form, its zone heeded and UTC without one; what follows the date is ignored; null when none fits."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +", ""), r"\s+", " ")
    return let(bare, lambda x: F.coalesce(*[_in_form(x, form, look) for form, look in FORMATS]))


def _in_form(c: Column, form: str, look: str) -> Column:
    first, zone = F.regexp_extract(c, look, 1), F.regexp_extract(c, look, 2)
    local = F.concat_ws(" ", first, F.trim(F.regexp_extract(c, look, 3))) if re.compile(look).groups > 2 else first
    return F.when(first != "", millis(F.try_to_timestamp(local, F.lit(form))) + F.coalesce(zone_minutes(zone), F.lit(0)) * 60_000)


def date_from_url(url: Column, allow_month: bool = False) -> Column:
    """Epoch milliseconds of the day (or month) written in a URL, else null."""
    tries = []
    for p in DAY_IN_URL:
        found = F.regexp_extract(url, p, 1)
        digits = F.regexp_replace(found, "[/-]", "-")
        form = F.when(digits.contains("-"), F.lit("yyyy-M-d")).otherwise(F.lit("yyyyMMdd"))
        tries.append(F.when(found != "", F.try_to_timestamp(digits, form)))
    if allow_month:
        month = F.regexp_extract(url, MONTH_IN_URL, 1)
        tries.append(F.when(month != "", F.try_to_timestamp(F.concat(month, F.lit("/01")), F.lit("yyyy/MM/dd"))))
    return millis(F.coalesce(*tries))


def effective_time(published: Column, crawled: Column, slack_ms: int = 36 * 3_600_000) -> Column:
    """The published time when the crawl came more than the slack after it, else the crawl time (0 when unset)."""
    crawled = F.coalesce(crawled, F.lit(0).cast("bigint"))
    return F.when(crawled - slack_ms > published, published).otherwise(crawled)


def human_age(ms: Column) -> Column:
    """12m, 5h or 3d."""
    minutes = F.floor(ms / 60_000)
    return F.when(minutes < 60, F.concat(minutes, F.lit("m"))).when(minutes < 1440, F.concat(F.floor(minutes / 60), F.lit("h"))).otherwise(F.concat(F.floor(minutes / 1440), F.lit("d")))


def ordinal_day(ts: Column) -> Column:
    d = F.dayofmonth(ts)
    suffix = F.when(d.isin(11, 12, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
    return F.concat(d.cast("string"), suffix)


def _offset_minutes(offset: Column) -> Column:
    """Minutes of a fixed offset ±HH:MM."""
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    return sign * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int"))


def local_minute(ms: Column, offset: Column) -> Column:
    """Minute of the day at a fixed offset ±HH:MM."""
    return F.pmod(F.floor(ms / 60_000) + _offset_minutes(offset), F.lit(1440))


def is_night(ms: Column, offset: Column) -> Column:
    m = local_minute(ms, offset)
    return (m < 8 * 60) | (m >= 22 * 60)


def is_morning(ms: Column, offset: Column) -> Column:
    """Nine to the end of the noon hour."""
    return local_minute(ms, offset).between(9 * 60, 13 * 60 - 1)


def is_daytime(ms: Column, offset: Column) -> Column:
    return local_minute(ms, offset).between(8 * 60, 20 * 60 - 1)


def is_around_noon(ms: Column, offset: Column) -> Column:
    return local_minute(ms, offset).between(11 * 60 + 46, 12 * 60 + 45)


def is_weekend(ms: Column, offset: Column) -> Column:
    days = F.floor((ms + _offset_minutes(offset) * 60_000) / 86_400_000)
    return F.pmod(days + 4, F.lit(7)).isin(0, 6)  # 1970-01-01 was a Thursday
