"""Printed dates and times: every reading a text allows, and the choice between readings.

``readings`` lists all valid interpretations of one value. ``choose`` runs Viterbi over the values of a chain
(records of one source in order). Its states are readings with the numeric order in force, which outlives values that
do not show it; a reading pays for contradicting the source's known order, for a change of that order, for another
format than its predecessor's, for going back in time, and for the later side of a clock change.
"""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "IST": 330, "BST": 60, "EST": -300, "EDT": -240, "GST": 240, "SGT": 480}

# Month names.
MONTHS = (
    "january february march april may june july august september october november december".split()
)
_MONTH = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
_WEEKDAY = r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\.?,? )?"
_DAY = (
    r"(?:(?P<y1>\d{4}) ?(?P<s1>[-/.]) ?(?P<m1>\d{1,2}) ?(?P=s1) ?(?P<d1>\d{1,2})"
    r"|(?P<a>\d{1,2}) ?(?P<s2>[-/.]) ?(?P<b>\d{1,2}) ?(?P=s2) ?(?P<y2>\d{4}|\d{2})"
    r"|(?P<d3>\d{1,2})(?:st|nd|rd|th)?[-/. ]+(?P<n3>[A-Za-z]{3,9})[-/., ]+(?P<y3>\d{4}|\d{2})"
    r"|(?P<n4>[A-Za-z]{3,9})\.? (?P<d4>\d{1,2})(?:st|nd|rd|th)?,? (?P<y4>\d{4})"
    r"|(?P<y5>\d{4})(?P<m5>\d\d)(?P<d5>\d\d))"
)
_TIME = (
    r"(?:(?:[T,]| ,?|, ) ?(?:(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<se>\d\d)(?:[.,](?P<f>\d{1,9}))?)?"
    r"|(?P<h2>\d\d)(?P<mi2>\d\d)(?P<se2>\d\d))(?: ?(?P<ap>[AaPp])\.?[Mm]\.?)?)?"
)
_ZONE = r"(?: ?(?P<z>Z|(?:UTC|GMT)? ?[+-]\d{1,2}:?\d\d|[A-Z]{3,4}|[A-Z][A-Za-z]+/[A-Za-z_]+(?:/[A-Za-z_]+)?))?"
_VALUE = re.compile(_WEEKDAY + _DAY + _TIME + _ZONE)
_OFFSET = re.compile(r"(?:UTC|GMT)? ?([+-])(\d{1,2}):?(\d\d)")
_PERIOD = re.compile(r"^(?:(?:from|period)\s+)?(.*\S)(?:\s+(?:to|till|until|upto|through)\s+|\s+[-–—]\s+|\s*[–—]\s*)(\S.*)$", re.I | re.S)
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)

#: A reading: (order, moment); order names the rule that gave it, moment is a date, or a datetime with a zone
#: (an instant) or without one (a local time of its source).
Reading = tuple[str, date | datetime]


@lru_cache(maxsize=512)
def zone(name: str) -> ZoneInfo | timezone | None:
    """The zone of an abbreviation, an offset or a zone name; None if there is no such zone."""
    if name in ABBREVIATIONS:
        return timezone(timedelta(minutes=ABBREVIATIONS[name]))
    if m := _OFFSET.fullmatch(name):
        minutes = int(m[2]) * 60 + int(m[3])
        return timezone(timedelta(minutes=-minutes if m[1] == "-" else minutes)) if minutes < 1440 else None
    if "/" in name:
        try:
            return ZoneInfo(name)
        except (KeyError, ValueError, OSError):
            return None
    return None


def clean(value: str | None) -> str:
    """Without stray asterisks and zero-width marks; runs of any white space are one blank."""
    if not value:
        return ""
    if not value.isascii():
        value = value.replace("​", "").replace("﻿", "").replace("−", "-")
    return " ".join(value.replace("*", " ").split())


def readings(value: str | None) -> list[Reading]:
    """All valid interpretations of one printed value; an empty list if it names no date.

    Null, blank and non-date texts give none. Day/month order of all-numeric dates yields up to two readings.
    Two-digit years are 20xx and never stand first; digits alone are a day (8) or Unix time in seconds (10) or
    milliseconds (13); of a fraction of a second six digits count. Texts of any length are read.
    """
    v = clean(value)
    if not v:
        return []
    n = len(v)
    if (n == 10 or n == 13) and v.isdecimal():
        u = int(v)
        return [("unix", _EPOCH + (timedelta(seconds=u) if n == 10 else timedelta(milliseconds=u)))]
    m = _VALUE.fullmatch(v)
    if m is None:
        return []
    g = m.groupdict()
    if g["y1"]:
        days = [("ymd", g["y1"], g["m1"], g["d1"])]
    elif g["a"]:
        if int(g["a"]) == int(g["b"]):
            days = [("same", g["y2"], g["b"], g["a"])]
        else:
            days = [("dmy", g["y2"], g["b"], g["a"]), ("mdy", g["y2"], g["a"], g["b"])]
    elif g["n3"]:
        days = [("name", g["y3"], _MONTH.get(g["n3"].lower(), 0), g["d3"])]
    elif g["n4"]:
        days = [("name", g["y4"], _MONTH.get(g["n4"].lower(), 0), g["d4"])]
    else:
        days = [("ymd", g["y5"], g["m5"], g["d5"])]
    clock = None
    hour = g["h"] or g["h2"]
    if hour is not None:
        hour, minute, second = int(hour), int(g["mi"] or g["mi2"]), int(g["se"] or g["se2"] or 0)
        if g["ap"]:
            if not 1 <= hour <= 12:
                return []
            hour = hour % 12 + (12 if g["ap"] in "Pp" else 0)
        if hour > 23 or minute > 59 or second > 59:
            return []
        clock = (hour, minute, second, int((g["f"] or "0")[:6].ljust(6, "0")))
    tz = None
    if g["z"] and (tz := zone(g["z"])) is None:
        return []
    out: list[Reading] = []
    for order, y, mo, d in days:
        y, mo, d = int(y), int(mo), int(d)
        try:
            out.append((order, datetime(y + 2000 if y < 100 else y, mo, d, *clock, tzinfo=tz) if clock else date(y + 2000 if y < 100 else y, mo, d)))
        except ValueError:
            continue
    return out


def allowed(options: list[Reading], date_order: str | None) -> list[Reading]:
    """The readings a source's known numeric order admits; all of them where the order is unknown."""
    if date_order not in ("DMY", "MDY") or not options:
        return options
    against = "mdy" if date_order == "DMY" else "dmy"
    return [r for r in options if r[0] != against]


def folded(options: list[Reading], tz: str | None) -> list[Reading]:
    """The readings with both sides of a clock change for local times that it repeats or skips in their zone."""
    out = []
    for order, moment in options:
        out.append((order, moment))
        if isinstance(moment, datetime) and tz and (moment.tzinfo is None or isinstance(moment.tzinfo, ZoneInfo)):
            local = moment if moment.tzinfo else moment.replace(tzinfo=zone(tz) or UTC)
            if local.utcoffset() != local.replace(fold=1).utcoffset():
                out.append((order, moment.replace(fold=1)))
    return out


#: Costs of Viterbi. Of a step: a change of the numeric order in force, a format other than the predecessor's, and a
#: step back in time (per record, plus per year up to ten). Of the order a chain begins with: month first, so that day
#: first wins where all else is equal. Of a reading: against the source's known order, and the later side of a clock
#: change, both dearer than all steps of a chain could be; no date at all lies between, and is offered where a source's
#: order admits none of the readings.
SWITCH, FORMAT, BACK, BACK_YEAR = 4.0, 0.25, 1.0, 0.5
MONTH_FIRST, NONE, AGAINST, LATER = 0.1, 1e6, 1e7, 1e7
_NUMERIC = ("dmy", "mdy")
_NO_DATE: Reading = ("none", date.min)


def _ordinal(moment: date | datetime) -> float:
    if isinstance(moment, datetime):
        return moment.toordinal() + (moment.hour * 60 + moment.minute) / 1440 + moment.fold / 24
    return float(moment.toordinal())


def choose(chain: list[list[Reading]], orders: list[str | None] | None = None, entry: str | None = None) -> list[Reading | None]:
    """Viterbi over a chain of values in record order; None where a value has no reading, or none that its source's
    known order (``orders``, one a value: DMY, MDY or None) admits. ``entry`` is the order in force (dmy, mdy) where
    the chain begins, if another chain goes before it.

    Values that can be read one way only add the same cost to every path between two of them, so steps are searched
    only where there is a choice or the order in force changes; the path found is that of the whole chain.
    """
    picked: list[Reading | None] = [None] * len(chain)
    known: list[int] = []
    columns: list[list[tuple[Reading, str, float]]] = []  # states of a value: reading, order in force, day
    back: list[list[int] | None] = []
    score: list[float] = []
    for i, options in enumerate(chain):
        if not options:
            continue
        admitted = allowed(options, orders[i]) if orders else options
        single = len(options) == 1 and len(admitted) == 1 and options[0][0] not in _NUMERIC
        states, own = [], []
        for r in options if admitted else [*options, _NO_DATE]:
            cost = 0.0 if r is not _NO_DATE else NONE
            cost += AGAINST if r is not _NO_DATE and r not in admitted else 0.0
            cost += LATER if isinstance(r[1], datetime) and r[1].fold else 0.0
            at = _ordinal(r[1]) if r is not _NO_DATE else float("nan")
            for order in (r[0],) if r[0] in _NUMERIC else _NUMERIC:
                states.append((r, order, at))
                own.append(cost)
        if not known:
            enter = {"dmy": 0.0, "mdy": MONTH_FIRST} if entry is None else {o: SWITCH * (o != entry) for o in _NUMERIC}
            score = [c + enter[order] for c, (_, order, _) in zip(own, states, strict=True)]
            back.append(None)
        elif single and len(columns[-1]) == 2 and columns[-1][0][0] is columns[-1][1][0]:
            back.append(None)  # from one certain value to the next: both orders stay as they are
        else:
            fresh, origin = [], []
            for (r, order, at), cost in zip(states, own, strict=True):
                best, arg = float("inf"), 0
                for j, (p, before, was) in enumerate(columns[-1]):
                    c = score[j] + (SWITCH if before != order else 0.0) + (FORMAT if p[0] != r[0] else 0.0)
                    step = was - at  # not a number where one of them is no date
                    if step > 0.5:
                        c += BACK + BACK_YEAR * min(10.0, step / 365)
                    if c < best:
                        best, arg = c, j
                fresh.append(best + cost)
                origin.append(arg)
            low = min(fresh)
            score = [x - low for x in fresh]  # paths compare by differences; so sums stay exact on long chains
            back.append(origin)
        known.append(i)
        columns.append(states)
    if not known:
        return picked
    j = min(range(len(score)), key=score.__getitem__)
    for k in range(len(known) - 1, -1, -1):
        r = columns[k][j][0]
        picked[known[k]] = None if r is _NO_DATE else r
        if back[k] is not None:
            j = back[k][j]
    return picked


def norm(reading: Reading | None, tz: str | None) -> str | None:
    """``YYYY-MM-DD``, or the UTC instant with microseconds; a local time takes the source's zone (UTC if unknown).

    Local times that a clock change skips or repeats take the offset in force before the change.
    """
    if reading is None:
        return None
    moment = reading[1]
    if not isinstance(moment, datetime):
        return moment.isoformat()
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=(tz and zone(tz)) or UTC)
    try:
        moment = moment.astimezone(UTC)
    except OverflowError:
        return None
    return moment.strftime("%Y-%m-%dT%H:%M:%S.%fZ") if moment.year > 999 else None


def instant(reading: Reading | None, tz: str | None) -> datetime | None:
    """The reading as a naive UTC time, a day at its midnight."""
    if reading is None:
        return None
    moment = reading[1]
    if not isinstance(moment, datetime):
        return datetime(moment.year, moment.month, moment.day)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=(tz and zone(tz)) or UTC)
    return moment.astimezone(UTC).replace(tzinfo=None)


def ends(period: str | None) -> tuple[str, str] | None:
    """The two printed ends of a period; None if the text has no two ends."""
    if not period:
        return None
    m = _PERIOD.match(period.replace(" ", " ").strip())
    return (m[1], m[2]) if m else None
