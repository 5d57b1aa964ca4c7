"""Several values packed in one text: a multi-pattern automaton finds known whole values, dynamic programming picks the best cover.
Pure Python.

A text is cut into atoms at every mark that may part values. A value is a run of atoms. Runs that are known whole values cost least,
whatever marks they hold; a few shapes cost a little more (a quoted text, "Surname, Given", an address up to the next one, codes joined
by a slash); lone atoms cost more, and other runs are no values. The cheapest cover of all atoms gives the values.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick

#: Words that part names, beside marks. A word parts only between blanks.
AND_WORDS = "and et und y & u e og och con with mit avec".split()
#: Words of bodies' names, lower case, without final dot.
BODY_WORDS = frozenset(
    "survey surv society soc department dept expedition exped institute inst institut museum garden gardens university univ club academy school college team party association assoc committee commission bureau station service laboratory lab herbarium group mission project company".split()
)
#: Starts of addresses.
ADDRESS_STARTS = ("https://", "http://", "ftp://", "urn:", "doi:", "ark:", "www.", "lsid:", "hdl:")
#: What may stand before the start of an address, as a class of a regular expression.
BEFORE_ADDRESS = r"[\s\"'<\[(,;|]"

_AND = "|".join(re.escape(w) for w in AND_WORDS)
_NAME_MARKS = re.compile(rf"(?P<hard>\s{{0,32}}[;|\n\t\r]+\s*|\s{{1,32}}[/+]\s+)|(?P<soft>\s{{0,32}},\s*|\s{{1,32}}(?:{_AND})(?=\s))", re.I)
_AND_AL = re.compile(rf"[\s,;|]{{0,32}}(?:(?:\b(?:et|and|und|y)|&)\s+(?:al(?:ii|ia)?\b\.?|others\b|collaborators\b))", re.I)
_QUOTED = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)+)'(?=\s*(?:[,;|\]]|$))|«([^»]*)»|“([^”]*)”")
_INITIALS = re.compile(r"^(?:[^\W\d_]{1,2}\.[\s-]*)+$|^[^\W\d_]$")
_GIVEN = re.compile(r"^(?:[^\W\d_]+\.?)(?:[\s-]+(?:[^\W\d_]{1,2}\.[\s-]*)+)?$|^(?:[^\W\d_]{1,2}\.[\s-]*)+$")
_PARTICLES = frozenset("de von van da del di le la".split())
_WORD = re.compile(r"[^\W\d_]+")
_ADDRESS_MARKS = re.compile(rf"{BEFORE_ADDRESS}+|>+(?={BEFORE_ADDRESS})")
_LANGUAGE_MARKS = re.compile(r"(?P<hard>[\s,;|&+]+|\s/\s)|(?P<slash>/)")
_START = re.compile("|".join(map(re.escape, ADDRESS_STARTS)), re.I)
_FIGURES = re.compile(r"\d+")
_ROUND = " \t\r\n\"'“”«»[](){}<>,;|"


@dataclass
class Atoms:
    """Pieces between possible marks; before each piece what parts it from the one before (hard, comma, and, slash); quoted pieces."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    quoted: set[tuple[int, int]] = field(default_factory=set)


def automaton(values: Iterable[str]) -> ahocorasick.Automaton | None:
    """The automaton of the known whole values, None without any."""
    a = ahocorasick.Automaton()
    for v in values:
        if v:
            a.add_word(v, len(v))
    if not len(a):
        return None
    a.make_automaton()
    return a


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _ROUND:
        a += 1
    while b > a and text[b - 1] in _ROUND:
        b -= 1
    return a, b


def _add(out: Atoms, text: str, a: int, b: int, mark: str) -> None:
    a, b = _trim(text, a, b)
    if a < b:
        out.spans.append((a, b))
        out.marks.append(mark)


def name_atoms(text: str) -> Atoms:
    """Names are parted by marks and words; what is quoted is whole; "et al." is none."""
    # blank out what is no value, keeping the places
    text = _AND_AL.sub(lambda m: ";" * len(m[0]), text)
    out, at, mark, pieces = Atoms(), 0, "hard", []
    for m in _QUOTED.finditer(text):
        pieces += [(at, m.start(), False), (m.start(), m.end(), True)]
        at = m.end()
    pieces.append((at, len(text), False))
    for s, e, whole in pieces:
        if whole:
            _add(out, text, s, e, "hard")
            out.quoted.add(_trim(text, s, e))
        else:
            start = s
            for m in _NAME_MARKS.finditer(text, s, e):
                _add(out, text, start, m.start(), mark)
                mark = "hard" if m["hard"] else "comma" if "," in m[0] else "and"
                start = m.end()
            _add(out, text, start, e, mark)
        mark = "hard"
    return out


def address_atoms(text: str) -> Atoms:
    out, at = Atoms(), 0
    for m in _ADDRESS_MARKS.finditer(text):
        _add(out, text, at, m.start(), "hard")
        at = m.end()
    _add(out, text, at, len(text), "hard")
    return out


def language_atoms(text: str) -> Atoms:
    out, at, mark = Atoms(), 0, "hard"
    for m in _LANGUAGE_MARKS.finditer(text):
        _add(out, text, at, m.start(), mark)
        mark, at = ("hard" if m["hard"] else "slash"), m.end()
    _add(out, text, at, len(text), mark)
    return out


ATOMS = {"name": name_atoms, "address": address_atoms, "language": language_atoms}


def pattern_of(text: str, kind: str) -> str:
    """What a known value is looked up by: itself, an address with each of its figures as 0."""
    return _FIGURES.sub("0", text) if kind == "address" else text


def known_runs(text: str, kind: str, atoms: Atoms, known: ahocorasick.Automaton | None) -> dict[int, list[int]]:
    """The runs of atoms that are known whole values: first atom -> atoms behind the last."""
    if known is None or not atoms.spans:
        return {}
    starts, ends = zip(*atoms.spans, strict=True)
    if kind == "address":
        # figures are searched as one 0 each: atoms lie nearer to the start by what is left out before them
        figures = [m.span() for m in _FIGURES.finditer(text)]
        behind, saved = [e for _, e in figures], [0, *accumulate(e - s - 1 for s, e in figures)]
        starts, ends = ([p - saved[bisect_right(behind, p)] for p in places] for places in (starts, ends))
        text = _FIGURES.sub("0", text)
    begin, end = {a: i for i, a in enumerate(starts)}, {b: j for j, b in enumerate(ends, 1)}
    out: dict[int, list[int]] = {}
    for last, n in known.iter(text):
        j = end.get(last + 1)
        if j is not None and (i := begin.get(last - n + 1)) is not None:
            out.setdefault(i, []).append(j)
    return out


def runs(text: str, kind: str, longest: int) -> list[str]:
    """Every run of up to longest atoms as it would be looked up."""
    spans = ATOMS[kind](text).spans
    return list({pattern_of(text[spans[i][0] : spans[j][1]], kind): None for i in range(len(spans)) for j in range(i, min(i + longest, len(spans)))})


def _name_shapes(text: str, atoms: Atoms, i: int) -> list[tuple[int, float]]:
    a, b = atoms.spans[i]
    if (a, b) in atoms.quoted:
        return [(i + 1, 0.05)]
    part = text[a:b]
    words = _WORD.findall(part)
    out = [(i + 1, 5.0 if _INITIALS.match(part) else 2.5 if len(words) == 1 else 1.0)]
    if i + 1 < len(atoms.spans) and atoms.marks[i + 1] == "comma":
        c, d = atoms.spans[i + 1]
        alone = len(words) == 1 and len(part) > 2 or len(words) == 2 and words[0].lower() in _PARTICLES
        if alone and _GIVEN.match(text[c:d]):
            out.append((i + 2, 1.05))
    return out


def _address_shapes(text: str, atoms: Atoms, i: int) -> list[tuple[int, float]]:
    if not _START.match(text, atoms.spans[i][0]):
        return [(i + 1, 3.0)]
    j, n = i + 1, len(atoms.spans)
    while j < n and not _START.match(text, atoms.spans[j][0]):
        j += 1
    return [(j, 0.5 + 0.5 * (j - i))] if j == i + 1 else [(j, 0.5 + 0.5 * (j - i)), (i + 1, 1.0)]


def _language_shapes(text: str, atoms: Atoms, i: int) -> list[tuple[int, float]]:
    out = [(i + 1, 0.0 if text[slice(*atoms.spans[i])].lower() in AND_WORDS else 1.0)]
    j = i + 1
    while j < len(atoms.spans) and atoms.marks[j] == "slash":
        j += 1
    if j > i + 1:
        # an undecided language
        out.append((j, 0.35))
    return out


SHAPES = {"name": _name_shapes, "address": _address_shapes, "language": _language_shapes}


def spans(text: str, kind: str, known: ahocorasick.Automaton | None) -> list[tuple[int, int]]:
    """The places of the values in the text, in order: the cheapest cover of its atoms."""
    atoms = ATOMS[kind](text)
    n = len(atoms.spans)
    hits = known_runs(text, kind, atoms, known)
    shapes = SHAPES[kind]
    costs, came = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for i in range(n):
        here = costs[i]
        for j, cost in shapes(text, atoms, i):
            if here + cost < costs[j]:
                costs[j], came[j] = here + cost, i
        for j in hits.get(i, ()):
            if here + 0.15 + 0.05 * (j - i) < costs[j]:
                costs[j], came[j] = here + 0.15 + 0.05 * (j - i), i
    out, j = [], n
    while j:
        i = came[j]
        a, b = atoms.spans[i][0], atoms.spans[j - 1][1]
        # a word that parts names parts codes too, unless it is known as a code, as Estonian's "et" may be
        if not (kind == "language" and j == i + 1 and j not in hits.get(i, ()) and text[a:b].lower() in AND_WORDS):
            out.append((a, b))
        j = i
    return out[::-1]


def split_values(text: str | None, kind: str, known: ahocorasick.Automaton | None) -> list[str]:
    """The values of the text as written, in order; none for null and blank texts."""
    if not text or not text.strip():
        return []
    return [text[a:b] for a, b in spans(text, kind, known)]
