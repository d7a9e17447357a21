"""Timestamps as Unix seconds.

``seconds`` is one native expression: a cheap look at a few characters picks the
form a text may have, one regular expression confirms it, and the parts are
cut out and summed.  ``parse`` is the same for one value on the driver.  Times
without a zone are UTC.
"""

from __future__ import annotations

import re
from datetime import UTC, date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .formats import let

MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_ZONE = r"(?P<zone>[Zz]|(?P<sign>[+-])(?P<zh>\d{2})(?::?(?P<zm>\d{2}))?)?"
_CLOCK = r"(?P<h>\d{2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,]\d*)?)?"
_FORMS = [
    re.compile(p, re.ASCII)
    for p in (
        rf"(?P<y>\d{{4}})(?P<sep>[-/])(?P<mo>\d{{2}})(?P=sep)(?P<d>\d{{2}})(?:[Tt ]{_CLOCK}{_ZONE})?",
        rf"(?P<d>\d{{2}})/(?P<mo>[A-Za-z]{{3}})/(?P<y>\d{{4}}):{_CLOCK} ?{_ZONE}",
        rf"(?P<mo>[A-Za-z]{{3}}) +(?P<d>\d{{1,2}}) {_CLOCK}",
        r"(?P<mo>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4})(?: (?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2}))? ?(?P<half>[AaPp][Mm])?)?",
    )
]
#: shortest text of the forms that have one
_LEAST = (0, 20, 15, 0)
_BLANKS = " \t\n\r\f"


def current_year() -> int:
    return datetime.now(UTC).year


def parse(text: str | None, year: int) -> int | None:
    """Unix seconds of one value, or None.  ``year`` is that of forms without one.

    Days run to 31 in every month and seconds to 60; what is over rolls on.
    """
    text = (text or "").strip(_BLANKS)
    if not text or len(text.encode()) > 40:
        return None
    if re.fullmatch(r"[0-9]+", text):
        unit = {10: 1, 13: 1000, 16: 1_000_000}.get(len(text))
        return int(text) // unit if unit else None
    for form, least in zip(_FORMS, _LEAST, strict=True):
        found = form.fullmatch(text)
        if not found or len(text) < least:
            continue
        part = found.groupdict()
        month = MONTHS.get(part["mo"].lower()) if part["mo"].isalpha() else int(part["mo"])
        y, day = int(part.get("y") or year), int(part["d"])
        hour, minute, second = (int(part.get(k) or 0) for k in ("h", "mi", "s"))
        half = (part.get("half") or "").lower()
        if half == "am" and hour == 12:
            hour = 0
        elif half == "pm" and hour < 12:
            hour += 12
        if not month or not (1 <= month <= 12 and 1 <= day <= 31 and 1900 <= y <= 2200 and hour <= 23 and minute <= 59 and second <= 60):
            return None
        offset = 0
        if part.get("sign"):
            offset = (int(part["zh"]) * 3600 + int(part["zm"] or 0) * 60) * (-1 if part["sign"] == "-" else 1)
        days = date(y, month, 1).toordinal() - date(1970, 1, 1).toordinal() + day - 1
        return days * 86_400 + hour * 3600 + minute * 60 + second - offset
    return None


_JAVA_CLOCK = r"\d{2}:\d{2}(?::\d{2}(?:[.,]\d*)?)?"
_JAVA_ZONE = r"(?:[Zz]|[+-]\d{2}(?::?\d{2})?)?"
_JAVA_US = r"\A(\d{1,2})/(\d{1,2})/(\d{4})(?: (\d{1,2}):(\d{2})(?::(\d{2}))? ?([AaPp][Mm])?)?\z"


def _total(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, offset: Column | None = None) -> Column:
    """Seconds of the parts, null unless they are in range; days and seconds beyond roll on."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    y = F.when(month <= 2, year - 1).otherwise(year)  # years from March on
    days = 365 * y + div(y, 4) - div(y, 100) + div(y, 400) + div(153 * ((month + 9) % 12) + 2, 5) + day - 719_469
    total = days.cast("bigint") * 86_400 + hour * 3600 + minute * 60 + second
    ok = month.between(1, 12) & day.between(1, 31) & year.between(1900, 2200) & (hour <= 23) & (minute <= 59) & (second <= 60)
    return F.when(ok, total if offset is None else total - offset)


def _number(text: Column) -> Column:
    """An integer of two to four digits; 0 for an empty text."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def _month(text: Column) -> Column:
    """Number of an English month's first three letters, 0 for others."""
    at = F.instr(F.lit("".join(MONTHS)), F.lower(text))
    return F.when((at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int")).otherwise(F.lit(0))


def _clock(text: Column) -> tuple[Column, Column, Column]:
    """Hour, minute and second of a text that begins with HH:MM or HH:MM:SS."""
    second = F.when(F.substring(text, 6, 1) == ":", _number(F.substring(text, 7, 2))).otherwise(F.lit(0))
    return _number(F.substring(text, 1, 2)), _number(F.substring(text, 4, 2)), second


def _offset(clock: Column) -> Column:
    """Seconds east of UTC that a text after HH:MM ends in."""
    zone = F.regexp_extract(clock, r"[+-][0-9:]+\z", 0)
    minutes = F.when(F.length(zone) > 3, _number(F.substring(zone, -2, 2))).otherwise(F.lit(0))
    size = _number(F.substring(zone, 2, 2)) * 3600 + minutes * 60
    return F.when(clock.rlike("[+-]"), F.when(zone.startswith("-"), -size).otherwise(size)).otherwise(F.lit(0))


def seconds(column: Column, kind: T.DataType, year: int | None = None) -> Column:
    """Unix seconds (bigint) of a column of type ``kind``, null where there is no timestamp."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_timestamp(column.cast("timestamp"))
    text = F.btrim(column.cast("string"), F.lit(_BLANKS))
    return let(text, lambda t: _seconds_of(t, year or current_year()))


def _seconds_of(text: Column, year: int) -> Column:
    """Unix seconds of a trimmed text."""
    at = lambda start, length: F.substring(text, start, length)
    zero = F.lit(0)

    digits = text.try_cast("bigint")
    units = F.when(F.length(text) == 10, digits).when(F.length(text) == 13, F.call_function("div", digits, F.lit(1000))).when(F.length(text) == 16, F.call_function("div", digits, F.lit(1_000_000)))

    clock = F.substring(text, 12, 40)
    dated = _total(_number(at(1, 4)), _number(at(6, 2)), _number(at(9, 2)), *_clock(clock), _offset(F.substring(text, 17, 40)))
    dated = F.when(text.rlike(rf"\A\d{{4}}([-/])\d{{2}}\1\d{{2}}(?:[Tt ]{_JAVA_CLOCK}{_JAVA_ZONE})?\z"), dated)

    log_clock = F.substring(text, 13, 40)
    logged = _total(_number(at(8, 4)), _month(at(4, 3)), _number(at(1, 2)), *_clock(log_clock), _offset(F.substring(text, 18, 40)))
    logged = F.when((F.length(text) >= _LEAST[1]) & text.rlike(rf"\A\d{{2}}/[A-Za-z]{{3}}/\d{{4}}:{_JAVA_CLOCK} ?{_JAVA_ZONE}\z"), logged)

    day = _number(F.substring_index(F.ltrim(F.substring(text, 4, 40)), " ", 1))
    system = _total(F.lit(year), _month(at(1, 3)), day, *_clock(F.substring_index(text, " ", -1)))
    system = F.when((F.length(text) >= _LEAST[2]) & text.rlike(rf"\A[A-Za-z]{{3}} +\d{{1,2}} {_JAVA_CLOCK}\z"), system)

    part = lambda k: F.regexp_extract(text, _JAVA_US, k)
    hour, half = _number(part(4)), F.lower(part(7))
    hour = F.when((half == "am") & (hour == 12), zero).when((half == "pm") & (hour < 12), hour + 12).otherwise(hour)
    american = F.when(text.rlike(_JAVA_US), _total(_number(part(3)), _number(part(1)), _number(part(2)), hour, _number(part(5)), _number(part(6))))

    found = (
        F.when(F.translate(text, "0123456789", "") == "", units)
        .when(at(5, 1).isin("-", "/"), F.coalesce(dated, american))
        .when(at(4, 1) == " ", system)
        .when((at(3, 1) == "/") & at(4, 1).rlike("[A-Za-z]"), logged)
        .when(at(2, 2).contains("/"), american)
    )
    return F.when((text != "") & (F.octet_length(text) <= 40), found)


def iso(column: Column) -> Column:
    """Unix seconds as ``YYYY-MM-DDTHH:MM:SSZ``."""
    return F.date_format(F.timestamp_seconds(column), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_text(value: int) -> str:
    return datetime.fromtimestamp(value, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def bucket(column: Column, width: int) -> Column:
    """Start of the bucket of so many seconds; times before 1970 are floored as well."""
    return (F.floor(column / F.lit(width)) * width).cast("bigint")


def width_of(text: str) -> int:
    """Seconds of a width such as ``30s``, ``5m``, ``1h``, ``1d`` or plain seconds."""
    found = re.fullmatch(r"([0-9]+)([smhd]?)", text.strip())
    if not found or int(found[1]) == 0:
        raise ValueError(f"invalid bucket width {text!r}")
    return int(found[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86_400}[found[2]]
