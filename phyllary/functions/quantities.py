"""Quantities in text: numbers, units, and the choice of units by physical identities among them. Pure Python."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from decimal import ROUND_FLOOR, Decimal
from itertools import product

#: Metres in each unit of length; foot words of any language mean the foot of 0.3048 m.
UNIT_WORDS = {
    "m": "m m. metre metres meter meters metro metros mètre mètres metri metern м метр метра метров 米 公尺 メートル masl mts mts.",
    "km": "km km. kilometre kilometres kilometer kilometers kilómetros kilomètres км 公里 千米",
    "ft": "ft ft. foot feet ' ′ ’ pied pieds fuß fuss pies pie pés piedi pedes ped ped. фут фута футов 英尺 フィート 呎",
    "yd": "yd yd. yds yds. yard yards 碼 ヤード",
}
FACTORS = {"m": Decimal(1), "km": Decimal(1000), "ft": Decimal("0.3048"), "yd": Decimal("0.9144")}
_METRIC = ("m", "km")
#: Difference of logarithms up to which two statements are the same quantity.
SAME = 0.02

UNITS = {w: u for u, words in UNIT_WORDS.items() for w in words.split()}
_NUM = r"[-−]?\d{1,3}(?:[,   ]\d{3})+(?!\d)|[-−]?\d+(?:[.,]\d+)?"
_WORD = "|".join(re.escape(w) for w in sorted(UNITS, key=len, reverse=True))
#: A unit ends where no letter follows; a quote mark needs no such end.
_UNIT = rf"(?:{_WORD})(?![^\W\d_]|\d)"
_TAILS = r"(?:\s*(?:a\.?\s?s\.?\s?l\.?|s\.\s?n\.\s?m\.|s\.\s?m\.|ü\.\s?M\.|ü\.\s?NN|над\s+ур\.\s*м\.|above\s+sea\s+level))?"
_SINGLE = rf"(?<![\d.,])(?P<n>{_NUM})\s*(?P<u>{_UNIT}){_TAILS}"
_RANGE = rf"(?<![\d.,])(?P<a>{_NUM})\s*(?:(?P<ua>{_UNIT}){_TAILS})?\s*(?:-|–|—|~|\bto\b|\band\b|\bbis\b|\ba\b|\bà\b|至)\s*(?P<b>{_NUM})\s*(?P<ub>{_UNIT}){_TAILS}"
_FIND = re.compile(rf"(?:{_RANGE})|(?:{_SINGLE})", re.I)
_BARE_RANGE = re.compile(rf"^\s*(?:alt|altitude|elev|elevation|c|ca|circa|about|between)?\.?:?\s*(?P<a>{_NUM})\s*(?:-|–|—|\bto\b|\band\b)\s*(?P<b>{_NUM})\s*$", re.I)
_BARE_BEFORE = re.compile(rf"(?:^|[\s:.])(?P<n>{_NUM})\s*[(\[/=]\s*$")
_BARE_BEHIND = re.compile(rf"^\s*[(\[/=]\s*(?P<n>{_NUM})\s*[)\]]?\s*$")
_BARE = re.compile(rf"^\s*(?:alt|altitude|elev|elevation|c|ca|circa|about|標高|海拔)?\.?:?\s*(?P<n>{_NUM})\s*$", re.I)
#: A length followed by these is a way or a size, not an altitude.
_WAY = re.compile(r"^\s*(?:(?:N|S|E|W|NE|NW|SE|SW|NNE|NNW|SSE|SSW|ENE|ESE|WNW|WSW)\b(?!\.)|(?:north|south|east|west)\w*\b|(?:of|from|off|along)\b|(?:tall|high|long|wide|thick|deep|apart|across)\b)", re.I)
_BELOW = re.compile(r"^\s*(?:below\s+(?:mean\s+)?sea(?:\s+level)?|b\.?\s?s\.?\s?l\.?|unter\s+(?:NN|dem\s+Meer)|sous\s+le\s+niveau|bajo\s+el\s+nivel|ниже\s+ур)", re.I)
Quantity = tuple[Decimal, tuple[str, ...]]


def number(text: str, unit: str | None) -> Decimal:
    """The number as written: comma, blank or point before groups of three digits part thousands, except in kilometres; else a comma is a decimal one."""
    t = text.replace("−", "-").replace(" ", " ").replace(" ", " ")
    if re.fullmatch(r"-?\d{1,3}(?:[, ]\d{3})+", t) and not (unit == "km" and "," in t):
        return Decimal(t.replace(",", "").replace(" ", ""))
    if re.fullmatch(r"-?[1-9]\d{0,2}(?:\.\d{3})+", t) and unit != "km":
        return Decimal(t.replace(".", ""))
    return Decimal(t.replace(",", "."))


def _unit(text: str | None) -> str | None:
    return UNITS[text.lower()] if text else None


def mentions(text: str, default: tuple[str, ...]) -> list[tuple[Quantity, Quantity]]:
    """The altitudes that the text states, each as (lowest, highest); a quantity is its number and the units it may have.

    default: the units that a lone number without unit may have; it is an altitude only if there are any. A number without unit that is
    set against one with a unit, in brackets or behind a slash or an equals sign, may have any unit.
    """
    found: list[tuple[Quantity, Quantity]] = []
    first, last = len(text), 0
    for m in _FIND.finditer(text):
        rest = text[m.end() :]
        if _WAY.match(rest):
            continue
        sign = -1 if _BELOW.match(rest) else 1
        if not found:
            first = m.start()
        last = m.end()
        if m["n"]:
            u = _unit(m["u"])
            q = (sign * number(m["n"], u), (u,))
            found.append((q, q))
        else:
            ub = _unit(m["ub"])
            ua = _unit(m["ua"]) or ub
            found.append(((sign * number(m["a"], ua), (ua,)), (sign * number(m["b"].lstrip("-−"), ub), (ub,))))
    if found:
        # a figure beside them without a unit of its own
        for m, at in ((_BARE_BEFORE.search(text[:first]), 0), (_BARE_BEHIND.match(text[last:]), len(found))):
            if m:
                q = (number(m["n"], None), tuple(FACTORS))
                found.insert(at, (q, q))
    elif default:
        if m := _BARE.match(text):
            q = (number(m["n"], None), default)
            found.append((q, q))
        elif m := _BARE_RANGE.match(text):
            found.append(((number(m["a"], None), default), (number(m["b"], None), default)))
    return found


def solve_units(
    values: Sequence[float], exponents: Sequence[int], candidates: Sequence[Sequence[str]], factors: Mapping[str, float], prior: Mapping[str, float] | None = None, tolerance: float = SAME
) -> tuple[tuple[str, ...], float, bool]:
    """The units, one for each value, under which the identity product(value_i * factor_i) ** exponent_i = 1 holds best.

    Returns (units, |log residual|, whether they are the only ones within tolerance of the best). Combinations that tie go to the
    higher sum of prior, then to the first. Values must not be 0. Every combination is tried: units a quantity may have are few.
    """
    scored = []
    for combo in product(*candidates):
        r = abs(sum(k * (math.log(abs(v)) + math.log(float(factors[u]))) for v, k, u in zip(values, exponents, combo, strict=True)))
        scored.append((r, -sum((prior or {}).get(u, 0.0) for u in combo), combo))
    best = min(scored, key=lambda x: (round(x[0], 9), x[1]))
    return best[2], best[0], sum(r <= best[0] + tolerance for r, _, _ in scored) == 1


def _half_up(x: Decimal) -> int:
    return int((x + Decimal("0.5")).to_integral_value(ROUND_FLOOR))


def agree(one: Quantity, two: Quantity, prior: str | None = None) -> tuple[bool, tuple[str, str], float, bool]:
    """(whether they can be one quantity, their units, |log residual|, whether no other units fit) by the identity one = two."""
    if one[0] == 0 or two[0] == 0 or (one[0] < 0) != (two[0] < 0):
        return abs(one[0] - two[0]) == 0, (one[1][0], two[1][0]), float(abs(one[0] - two[0])), len(one[1]) == len(two[1]) == 1
    units, residual, only = solve_units([float(one[0]), float(two[0])], [1, -1], [one[1], two[1]], FACTORS, {prior: 1.0} if prior else None)
    # metres are rounded to whole ones: a difference of one metre is no difference
    close = [c for c in product(one[1], two[1]) if abs(one[0] * FACTORS[c[0]] - two[0] * FACTORS[c[1]]) <= 1]
    if residual > SAME and close:
        units = next((c for c in close if c[0] == prior), close[0])
    return residual <= SAME or bool(close), units, residual, only and len(close) < 2


def _metres(q: Quantity, unit: str) -> int:
    return _half_up(q[0] * FACTORS[unit])


def read_altitude(text: str | None, default: tuple[str, ...], evidence: int | None = None) -> tuple[int, int, bool, float] | None:
    """(lowest, highest, unique, residual) in whole metres, None if the text states no altitude.

    default: the units that a number without unit may have, likeliest first. evidence: the altitude in metres that something else gives
    for the same thing; by the identity of the two the unit of a number without unit is chosen, by the least logarithmic residual, or
    the likeliest where none fits. Statements next to each other that the identity first = second holds for, under some of their units,
    are one altitude given twice: the one in metres counts. Other statements widen the span. unique is False where more than one choice
    of units fits, or nothing but the default speaks for one. residual is the greatest of the identities that were used.
    """
    if not text or not (found := mentions(text, default)):
        return None
    unique, residual = True, 0.0
    kept: list[list] = []
    for one, two in found:
        if kept:
            before = kept[-1]
            tests = [agree(q[:2], own) for q, own in zip(before, (one, two), strict=True)]
            if all(t[0] for t in tests):
                residual = max(residual, *(t[2] for t in tests))
                unique &= all(t[3] for t in tests)
                # the one in metres counts, the first of two alike
                kept[-1] = [(q[0], (u[0],)) if u[0] in _METRIC or u[1] not in _METRIC else (own[0], (u[1],)) for q, own, (_, u, _, _) in zip(before, (one, two), tests, strict=True)]
                continue
        kept.append([one, two])
    # a figure of any unit that agrees with nothing tells nothing
    kept = [k for k in kept if len(k[0][1]) < len(FACTORS)] or kept
    values = []
    for pair in kept:
        units = pair[0][1]
        chosen = units[0]
        if len(units) > 1:
            fits, both, r, only = agree(pair[0], (Decimal(evidence), ("m",)), units[0]) if evidence is not None else (False, None, 0.0, False)
            unique &= fits and only
            if fits:
                chosen, residual = both[0], max(residual, r)
        values += [_metres(q, chosen if len(q[1]) > 1 else q[1][0]) for q in pair]
    return min(values), max(values), unique, residual
