"""Reading of dates and times as people and machines write them. Pure Python, one text at a time; callers keep a memo per batch."""

from __future__ import annotations

import re
from calendar import monthrange
from datetime import datetime, timedelta, timezone
from functools import lru_cache

#: Month names by language; every name is lower case, without its final dot.
MONTH_NAMES = {
    "en": "january february march april may june july august september october november december",
    "en_short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "de_at": "jänner feber märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "la": "januarii februarii martii aprilis maii junii julii augusti septembris octobris novembris decembris",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "ru_nom": "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
    "roman": "i ii iii iv v vi vii viii ix x xi xii",
}
#: Thai month abbreviations and names; years beside them are of the Buddhist era.
THAI_MONTHS = "ม.ค. ก.พ. มี.ค. เม.ย. พ.ค. มิ.ย. ก.ค. ส.ค. ก.ย. ต.ค. พ.ย. ธ.ค.".split()
THAI_NAMES = "มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม".split()
#: Year before the first year of each era.
ERAS = {"明治": 1867, "大正": 1911, "昭和": 1925, "平成": 1988, "令和": 2018, "民國": 1911, "民国": 1911}
#: Usual offsets of zone abbreviations, in minutes east.
ZONES = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "ICT": 420, "WIB": 420, "WITA": 480, "WIT": 540, "SGT": 480, "HKT": 480, "PHT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

#: Abbreviations that other zones share: Central and China, India and Ireland and Israel, Britain and Bangladesh, Atlantic and Arabia.
SHARED_ZONES = ("CST", "IST", "BST", "AST")

MONTHS = {w: i + 1 for names in MONTH_NAMES.values() for i, w in enumerate(names.split())} | {"sept": 9, "setiembre": 9, "mär": 3, "mai": 5, "okt": 10, "dez": 12}
THAI = {w: i + 1 for words in (THAI_MONTHS, THAI_NAMES) for i, w in enumerate(words)}

_Y, _N = r"(?P<y>\d{4})", r"[^\W\d_]+"
_MON = rf"(?P<mon>{_N})\.?"
_ZONE = r"(?P<z>Z|[+-]\d{2}(?::?\d{2})?|\[?[A-Z][A-Za-z_]+/[A-Za-z0-9_/+-]+\]?|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?|[A-Z]{2,5})"
_TIME = r"(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,]\d+)?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_CLOCK = rf"(?:[T,]?\s*{_TIME}(?:\s*(?:h|hrs|Uhr|часов))?\s*{_ZONE}?|\s+(?P<hm>\d{{4}})\s*(?:h|hrs|Uhr)\.?\s*{_ZONE.replace('?P<z>', '?P<z2>')}?)?"
_TAIL = r"(?:\s*г\.?)?"

_PREFIX = re.compile(r"^\s*(?:(?:coll(?:ected|\.)?|leg\.?|legit|det\.?|dated?|datum|fecha|дата)\.?(?:\s+(?:date|on))?\s*[:.]?\s+)+", re.I)
_SPANS = [
    re.compile(rf"^{_Y}-(?P<m>\d\d?)-(?P<d>\d\d?)\s*/\s*(?P<d2>\d\d?)$"),
    re.compile(rf"^{_Y}-(?P<m>\d\d?)-(?P<d>\d\d?)\s*(?:to|/|–|bis|au|until|through)\s*(?P<y2>\d{{4}})-(?P<m2>\d\d?)-(?P<d2>\d\d?)$"),
    re.compile(rf"^(?P<d>\d\d?)\.?\s*(?:[-–]|to|bis|au|al)\s*(?P<d2>\d\d?)\.?\s*(?:de\s+)?{_MON}\s*(?:de\s+)?{_Y}{_TAIL}$", re.I),
    re.compile(rf"^(?P<d>\d\d?)\.?\s*[-–]\s*(?P<d2>\d\d?)\.(?P<m>\d\d?)\.{_Y}$"),
    re.compile(rf"^{_MON}\s+(?P<d>\d\d?)(?:st|nd|rd|th)?\s*(?:to|[-–])\s*(?P<d2>\d\d?)(?:st|nd|rd|th)?,?\s+{_Y}$", re.I),
    re.compile(rf"^(?P<d>\d\d?)\.?\s*{_MON}\s*(?:to|[-–]|bis)\s*(?P<d2>\d\d?)\.?\s*(?P<mon2>{_N})\.?\s*{_Y}$", re.I),
]
_DATES = [
    re.compile(rf"^{_Y}-(?P<m>\d\d?)-(?P<d>\d\d?){_CLOCK}$"),
    re.compile(rf"^{_Y}/(?P<m>\d\d?)/(?P<d>\d\d?){_CLOCK}$"),
    re.compile(rf"^{_Y}\.(?P<m>\d\d?)\.(?P<d>\d\d?){_CLOCK}$"),
    re.compile(r"^(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)(?:T(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)?(?P<z>Z|[+-]\d\d:?\d\d)?)?$"),
    re.compile(rf"^{_Y}[-/](?P<m>\d\d?)$"),
    re.compile(rf"^{_Y}$"),
    re.compile(rf"^{_Y}-(?P<j>\d{{3}})$"),
    re.compile(rf"^(?P<a>\d\d?)(?P<sep>[-/])(?P<b>\d\d?)(?P=sep){_Y}{_CLOCK}$"),
    re.compile(rf"^(?P<d>\d\d?)\.\s*(?P<m>\d\d?)\.\s*{_Y}{_CLOCK}$"),
    re.compile(rf"^(?P<m>\d\d?)[-/.]{_Y}$"),
    re.compile(rf"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+)?(?P<d>\d\d?)(?:st|nd|rd|th|er|\.|º)?[\s.-]*(?:de\s+)?{_MON}[\s.,-]*(?:de\s+)?{_Y}{_TAIL}{_CLOCK}$", re.I),
    re.compile(rf"^{_MON}\s+(?P<d>\d\d?)(?:st|nd|rd|th)?,?\s+{_Y}{_CLOCK}$", re.I),
    re.compile(rf"^{_MON},?[\s.-]*(?:de\s+)?{_Y}{_TAIL}$", re.I),
    re.compile(rf"^(?P<d>\d\d?)\s*(?P<thai>{'|'.join(map(re.escape, THAI))})\s*(?:พ\.ศ\.\s*)?{_Y}$"),
    re.compile(rf"^(?P<thai>{'|'.join(map(re.escape, THAI))})\s*(?:พ\.ศ\.\s*)?{_Y}$"),
    re.compile(rf"^(?P<era>{'|'.join(ERAS)})?\s*(?P<y>\d{{1,4}}|元)年\s*(?:(?P<m>\d\d?)月\s*(?:(?P<d>\d\d?)日)?)?$"),
]
_EPOCH = re.compile(r"^-?\d{9,14}$")
_OFFSET = re.compile(r"^(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?$")
EPOCH = datetime(1970, 1, 1)
Reading = tuple["str | None", "int | None", "str | None"]
NOTHING: Reading = (None, None, None)


def instant(seconds: int) -> str | None:
    """UTC text of the seconds since 1970, or None outside the years 1 to 9999."""
    try:
        return (EPOCH + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ").zfill(20)
    except OverflowError:
        return None


def _day(y: int, m: int, d: int) -> str | None:
    if 1 <= y <= 9999 and 1 <= m <= 12 and 1 <= d <= monthrange(y, m)[1]:
        return f"{y:04d}-{m:02d}-{d:02d}"
    return None


def _month(g: dict) -> int | None:
    if g.get("thai"):
        return THAI[g["thai"]]
    if g.get("mon"):
        return MONTHS.get(g["mon"].lower())
    return int(g["m"]) if g.get("m") else None


def _span(g: dict) -> str | None:
    y, m = int(g["y"]), _month(g)
    m2 = int(g["m2"]) if g.get("m2") else MONTHS.get(g["mon2"].lower(), 0) if g.get("mon2") else m
    if not m or not m2:
        return None
    a, b = _day(y, m, int(g["d"])), _day(int(g.get("y2") or y), m2, int(g["d2"]))
    if not a or not b or a > b:
        return None
    return a if a == b else f"{a}/{b}"


def read_date(text: str | None, order: str | None) -> Reading:
    """The text as (normal text, None, None), or (None, local seconds since 1970, zone) if a zone's rules must still be applied.

    order rules dates of three numbers parted by slash or hyphen that do not begin with the year (dmy, mdy, ymd).
    The zone is "" where the text gives none. (None, None, None) for a text without a possible date.
    """
    if not text or not (text := text.strip()):
        return NOTHING
    if _EPOCH.match(text):
        n = int(text)
        digits = len(text.lstrip("-"))
        return (instant(n // 1000 if digits >= 11 else n), None, None)
    text = _PREFIX.sub("", text).strip()
    for p in _SPANS:
        if found := p.match(text):
            if span := _span(found.groupdict()):
                return (span, None, None)
    for p in _DATES:
        if (found := p.match(text)) and (r := _read(found.groupdict(), order)) is not None:
            return r
    return NOTHING


def _read(g: dict, order: str | None) -> Reading | None:
    """A reading of the parts; None if another pattern may fit, NOTHING if the date is impossible."""
    y = 1 if g["y"] == "元" else int(g["y"])
    if g.get("era"):
        y += ERAS[g["era"]]
    elif g.get("thai") and y > 2300:
        y -= 543
    if g.get("j"):
        j = int(g["j"])
        if not 1 <= j <= (366 if monthrange(y, 2)[1] == 29 else 365):
            return NOTHING
        return ((datetime(y, 1, 1) + timedelta(days=j - 1)).strftime("%Y-%m-%d").zfill(10), None, None)
    if g.get("a"):
        a, b = int(g["a"]), int(g["b"])
        m, d = (a, b) if order == "mdy" else (b, a)
    else:
        m, d = _month(g), int(g["d"]) if g.get("d") else None
        if g.get("mon") and m is None:
            return None
    if m is None:
        return (f"{y:04d}", None, None) if 1 <= y else NOTHING
    if not 1 <= m <= 12 or not 1 <= y <= 9999:
        return NOTHING
    if d is None:
        return (f"{y:04d}-{m:02d}", None, None)
    day = _day(y, m, d)
    if not day:
        return NOTHING
    if g.get("hm"):
        h, mi, s = int(g["hm"][:2]), int(g["hm"][2:]), 0
    elif g.get("h"):
        h, mi, s = int(g["h"]), int(g["mi"]), int(g.get("s") or 0)
    else:
        return (day, None, None)
    if g.get("ap"):
        if not 1 <= h <= 12:
            return NOTHING
        h = h % 12 + 12 * (g["ap"] in "Pp")
    if h > 24 or mi > 59 or s > 60 or h == 24 and (mi or s):
        return NOTHING
    local = int((datetime(y, m, d) - EPOCH).total_seconds()) + 3600 * h + 60 * mi + s
    zone = (g.get("z") or g.get("z2") or "").strip("[]")
    if "/" in zone:
        return (None, local, zone)
    if not zone:
        return (None, local, "")
    minutes = zone_minutes(zone)
    return NOTHING if minutes is None else (instant(local - 60 * minutes), None, None)


@lru_cache(4096)
def zone_minutes(zone: str) -> int | None:
    """Minutes east of UTC of an offset or a zone abbreviation, None if unknown."""
    if found := _OFFSET.match(zone):
        n = int(found[2]) * 60 + int(found[3] or 0)
        return (n if found[1] == "+" else -n) if n <= 18 * 60 else None
    return ZONES.get(zone.upper())


def zone_intervals(name: str, first: int = 1900, last: int = 2100) -> list[tuple[int, int, int]]:
    """The zone's spans of one offset, in order, as (first second UTC, second after the last, offset in seconds), open ends at years 1 and 9999."""
    from zoneinfo import ZoneInfo

    zone = ZoneInfo(name)

    def offset(t: int) -> int:
        return int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())

    def second(year: int) -> int:
        return int((datetime(year, 1, 1) - EPOCH).total_seconds())

    spans, start, step = [], second(2), 7 * 86400
    at, known = second(first - 50), offset(second(first - 50))
    while at < second(last + 1):
        new = offset(at + step)
        if new != known:
            low, high = at, at + step
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == known else (low, mid)
            spans.append((start, high, known))
            start, known = high, offset(high)
            at = high
        else:
            at += step
    return [*spans, (start, second(9998), known)]


@lru_cache(1024)
def _local_intervals(zone: str) -> tuple[tuple[int, int, int], ...]:
    return tuple((a + off, b + off, off) for a, b, off in zone_intervals(zone))


def resolve_local(local: int, zone: str) -> str | None:
    """The instant of a local time in a zone: a repeated time is the earlier instant, a skipped one has the offset before the change; None
    for an unknown zone."""
    from zoneinfo import available_timezones

    if zone not in available_timezones():
        return None
    spans = _local_intervals(zone)
    fits = [off for a, b, off in spans if a <= local < b]
    return instant(local - (max(fits) if fits else [off for _, b, off in spans if b <= local][-1]))


def normal_time(text: str | None, order: str | None, zone: str | None = None) -> str | None:
    """The normal text of a date or time; local times need a zone in the text or the one given."""
    normal, local, own = read_date(text, order)
    if local is None:
        return normal
    return resolve_local(local, own or zone) if own or zone else None
