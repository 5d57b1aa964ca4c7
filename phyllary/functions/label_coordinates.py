"""Coordinates read out of label texts. Pure Python.

A text is cut into numbers, words, marks and blanks. A small grammar reads single axes (a latitude or a longitude) at each number or
word, in one of four notations; a latitude and a longitude of one notation that stand close together make a coordinate:

    labelled   lat: 23.5, latitude = 23.5, N 23.5           in either order, no figure between the two
    lettered   23.5 N, 23.5° N
    led        N 23° 30′ 15″, N 23                           minutes and seconds as far as given
    closed     23° 30′ 15″ N, 23° N

Letters and words count only where they stand alone, and a figure only as a whole: 2023 N is no latitude.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

#: Datum names in the order in which they are looked for: (name, texts of which all must occur) (fixed values).
DATUMS = [("TWD67", [["TWD67"], ["TWD 67"]]), ("TWD97", [["TWD97"], ["TWD 97"]]), ("WGS84", [["WGS84"], ["WGS 84"]]), ("Tokyo", [["TOKYO", "DATUM"]])]
#: Characters beside a sexagesimal coordinate in which a datum may be named.
CONTEXT = 20
#: Words for an axis before a decimal number.
LABELS = {"lat": "lat", "latitude": "lat", "n": "lat", "lon": "lon", "long": "lon", "longitude": "lon", "lng": "lon", "e": "lon"}
#: Hemispheres: axis and sign.
LETTERS = {"n": ("lat", 1), "s": ("lat", -1), "e": ("lon", 1), "w": ("lon", -1)}
_AXIS_WORDS = frozenset(LABELS) | frozenset(LETTERS)
#: Digits that whole degrees may have.
DIGITS = {"lat": 2, "lon": 3}
MARKS = {"°": "d", "º": "d", "′": "m", "'": "m", "″": "s", '"': "s"}
#: Every character is in a token.
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[^\W\d_°º]+|[ \t]+|.", re.S)
#: Characters between the two axes at most, by notation.
REACH = {"labelled": 30, "lettered": 40, "led": 40, "closed": 40}


def _kind(c: str) -> str:
    """The kind of a token by its first character."""
    return MARKS.get(c) or ("n" if c.isdecimal() else "w" if c.isalpha() else "b" if c in " \t" else "o")


#: Kinds of the characters that texts mostly consist of.
_KINDS = {c: _kind(c) for c in [chr(i) for i in range(128)] + list(MARKS)}


class Axis(NamedTuple):
    """One axis as read: value in degrees, its place in the text, decimals of the last part given, and which part that is."""

    axis: str
    value: float
    start: int
    end: int
    places: int
    part: str


class Tokens:
    """A text cut up. kinds has a letter a token: n number, w word, d, m, s marks of degrees, minutes and seconds, b blanks within a
    line, o other characters, and a last one, e, behind the text; texts, starts and ends are theirs."""

    def __init__(self, text: str) -> None:
        self.texts = _TOKEN.findall(text)
        self.kinds = [_KINDS.get(t[0]) or _kind(t[0]) for t in self.texts]
        self.ends = list(accumulate(map(len, self.texts)))
        self.starts = [0, *self.ends]
        self.texts.append("")
        self.kinds.append("e")
        self.ends.append(len(text))


def _past(ts: Tokens, i: int) -> int:
    return i + 1 if ts.kinds[i] == "b" else i


def _past_space(ts: Tokens, i: int) -> int:
    """Past blanks, also ends of lines."""
    while ts.kinds[i] == "b" or ts.kinds[i] == "o" and ts.texts[i].isspace():
        i += 1
    return i


def _places(figure: str) -> int:
    return len(figure.partition(".")[2])


def _whole(figure: str, digits: int) -> bool:
    return len(figure.partition(".")[0]) <= digits


def _labelled(ts: Tokens, i: int) -> Axis | None:
    axis = LABELS.get(ts.texts[i].lower())
    if not axis:
        return None
    start, texts = ts.starts[i], ts.texts
    long = len(texts[i]) > 1
    i += 1
    if texts[i] == "." and long:
        i += 1
    i = _past_space(ts, i)
    if texts[i] in (":", "="):
        i = _past_space(ts, i + 1)
    sign = -1.0 if texts[i] == "-" else 1.0
    if texts[i] in ("+", "-"):
        i += 1
    if ts.kinds[i] != "n":
        return None
    return Axis(axis, sign * float(texts[i]), start, ts.ends[i], _places(texts[i]), "")


def _lettered(ts: Tokens, i: int) -> Axis | None:
    j = _past_space(ts, i + 1)
    if ts.texts[j] == "°":
        j = _past_space(ts, j + 1)
    axis, sign = LETTERS.get(ts.texts[j].lower(), (None, 0))
    if not axis or not _whole(ts.texts[i], DIGITS[axis]):
        return None
    return Axis(axis, sign * float(ts.texts[i]), ts.starts[i], ts.ends[j], _places(ts.texts[i]), "")


def _parts(ts: Tokens, i: int, must_mark: bool) -> tuple[list[str], int, int] | None:
    """(degrees, minutes, seconds as far as given, where they end, next token) from a whole number on. With must_mark degrees need
    their mark, and minutes theirs; else a lone number is degrees, and minutes may end without a mark."""
    kinds, texts = ts.kinds, ts.texts
    if kinds[i] != "n" or "." in texts[i]:
        return None
    found, end = [texts[i]], i
    j = _past(ts, i + 1)
    if kinds[j] != "d":
        return None if must_mark else (found, ts.ends[end], end + 1)
    if must_mark:
        end = j
    k = _past(ts, j + 1)
    if kinds[k] != "n" or not _whole(texts[k], 2):
        return found, ts.ends[end], end + 1
    m = _past(ts, k + 1)
    if kinds[m] != "m":
        return (found, ts.ends[end], end + 1) if must_mark else ([*found, texts[k]], ts.ends[k], k + 1)
    found.append(texts[k])
    end = m
    s = _past(ts, m + 1)
    if kinds[s] == "n" and _whole(texts[s], 2):
        found.append(texts[s])
        end = s
        q = _past(ts, s + 1)
        if kinds[q] == "s":
            end = q
    return found, ts.ends[end], end + 1


def _sexagesimal(letter: str, parts: list[str], start: int, end: int) -> Axis | None:
    axis, sign = LETTERS[letter]
    if not _whole(parts[0], DIGITS[axis]):
        return None
    value, unit = 0.0, 1
    for p in parts:
        value += float(p) / unit
        unit *= 60
    return Axis(axis, sign * value, start, end, _places(parts[-1]), "dms"[len(parts) - 1])


def _led(ts: Tokens, i: int) -> Axis | None:
    letter = ts.texts[i].lower()
    if letter not in LETTERS or not (got := _parts(ts, _past(ts, i + 1), False)):
        return None
    return _sexagesimal(letter, got[0], ts.starts[i], got[1])


def _closed(ts: Tokens, i: int) -> Axis | None:
    if not (got := _parts(ts, i, True)):
        return None
    at = _past(ts, got[2])
    letter = ts.texts[at].lower()
    return _sexagesimal(letter, got[0], ts.starts[i], ts.ends[at]) if letter in LETTERS else None


#: Readers of the notations, in order, and at which tokens they begin: words (w) or numbers (n).
READERS = {"labelled": ("w", _labelled), "lettered": ("n", _lettered), "led": ("w", _led), "closed": ("n", _closed)}


def _pairs(text: str, axes: list[Axis], first: str, reach: int, no_figure: bool) -> Iterator[tuple[Axis, Axis]]:
    """Each axis of the kind that comes first with the next one of the other kind within reach, none used twice."""
    others = [a for a in axes if a.axis != first]
    starts, at = [a.start for a in others], 0
    for a in axes:
        if a.axis != first or a.start < at:
            continue
        k = bisect_left(starts, a.end)
        if k == len(others) or starts[k] - a.end > reach:
            continue
        if no_figure and any(c.isdecimal() for c in text[a.end : starts[k]]):
            continue
        at = others[k].end
        yield a, others[k]


def datum_in(text: str) -> str:
    up = text.upper()
    return next((name for name, ways in DATUMS if any(all(w in up for w in way) for way in ways)), "")


def _open_m(a: Axis) -> int:
    """Metres that the last part given leaves open: about 30 m for a second, 2 km for a minute, 111 km for a degree."""
    return {"s": max(1, round(30 / 10**a.places)), "m": max(20, round(2000 / 10**a.places)), "d": 111_000}[a.part]


def _found(text: str) -> Iterator[tuple]:
    ts = Tokens(text)
    words = [i for i, k in enumerate(ts.kinds) if k == "w" and ts.texts[i].lower() in _AXIS_WORDS]
    if len(words) < 2:
        return
    # a figure that an axis begins with has a mark, a blank or a letter behind it
    begins = {"w": words, "n": [i for i, k in enumerate(ts.kinds) if k == "n" and ts.kinds[i + 1] in "dbwo"]}
    for notation, (kind, read) in READERS.items():
        axes = [a for i in begins[kind] if (a := read(ts, i))]
        if len(axes) < 2:
            continue
        for first in ("lat", "lon") if notation == "labelled" else ("lat",):
            for one, two in _pairs(text, axes, first, REACH[notation], notation == "labelled"):
                lat, lon = (one, two) if first == "lat" else (two, one)
                source = text[one.start : two.end]
                if notation in ("labelled", "lettered"):
                    places = min(lat.places, lon.places)
                    yield lat.value, lon.value, source, "decimal", datum_in(source), max(1, round(111_000 / 10**places)), f"decimal_{places}dp"
                else:
                    around = text[max(0, one.start - CONTEXT) : two.end + CONTEXT]
                    coarser = min(lat.part, lon.part, key="dms".index)
                    yield lat.value, lon.value, source, "dms", datum_in(around), max(_open_m(lat), _open_m(lon)), {"d": "dms_degrees", "m": "dms_minutes", "s": "dms_seconds"}[coarser]


def read_coordinates(text: str | None) -> list[tuple]:
    """(latitude, longitude, source text, notation, datum, uncertainty in metres, kind of precision) of each coordinate in the text,
    one for each place to eight decimals and notation; places out of range are none."""
    out, seen = [], set()
    for c in _found(text or ""):
        key = (round(c[0], 8), round(c[1], 8), c[3])
        if -90 <= c[0] <= 90 and -180 <= c[1] <= 180 and key not in seen:
            seen.add(key)
            out.append(c)
    return out
