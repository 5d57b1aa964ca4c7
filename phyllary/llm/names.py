"""Names of people and bodies taken apart and compared (problem 6). Pure Python."""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

from phyllary.functions.segments import BODY_WORDS

TITLES = frozenset("dr prof professor mr mrs ms miss sir rev fr sr herr frau mme mlle m lic ing don dona lady capt captain col major lt".split())
PARTICLES = frozenset("van von der den de la le du da del della di dos des ter ten zu zur af av".split())
LINKING = frozenset("the of and et und y for de la le des du für".split())
#: Everyday forms of given names: what people are called, for each formal name.
EVERYDAY = {
    "aleksandr": "sasha sascha shura alex alik", "alexander": "alex sandy sasha xander", "andrew": "andy drew", "anthony": "tony", "antonio": "toni tono", "bartholomew": "bart barty", "benjamin": "ben benny",
    "catherine": "kate cathy kitty cath", "charles": "charlie chuck chas", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy", "dorothea": "thea dora dorle", "dorothy": "dot dolly",
    "edward": "ed eddie ted ned", "elisabeth": "lisbeth lisa liesel elsbeth else sisi", "elizabeth": "liz beth betty eliza lizzie", "francisco": "paco pancho curro", "frederick": "fred freddy", "friedrich": "fritz",
    "george": "georgie", "guadalupe": "lupe lupita", "heinrich": "heinz heini heiner", "henry": "harry hank", "ignacio": "nacho", "james": "jim jimmy", "johann": "hans", "johannes": "hannes hans jo", "john": "jack johnny",
    "jose": "pepe", "joseph": "joe joey", "josef": "sepp", "katharina": "kathi kathe katja trina", "lawrence": "larry", "leonie": "leo leni", "margaret": "peggy maggie meg madge greta", "maria": "mia mitzi", "matthew": "matt",
    "michael": "mike mick", "nathaniel": "nat nate", "nicholas": "nick", "ottilie": "otti tilly tilli", "patricia": "pat patty", "peter": "pete", "philippa": "pippa pip", "rebecca": "becky", "richard": "dick rick",
    "robert": "bob bobby rob bert", "samuel": "sam", "stephen": "steve", "susan": "sue susie", "theodor": "theo teddy", "theodore": "ted theo", "thomas": "tom", "ursula": "uschi ulla ursel", "valentina": "tina valya vale",
    "victoria": "vicky", "walter": "walt", "wilhelm": "willi", "william": "bill will billy willy", "xaver": "xaverl veri", "yevgenia": "zhenya genya", "yevgeny": "zhenya", "zachary": "zach zack",
}
#: Similarity that candidates' main parts are to be found at, the share to be found, and rows of a band.
TARGET, RECALL, BAND_ROWS = 0.4, 0.985, 3
ALIKE = 0.9
#: Edits by which a main part or a given name may differ. One is what typing brings about; two links transliterations, and more people who
#: are not the same.
EDITS = 1

FORMAL: dict[str, tuple[str, ...]] = {}
for _formal, _names in EVERYDAY.items():
    for _n in _names.split():
        FORMAL[_n] = (*FORMAL.get(_n, ()), _formal)

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")


def bands_for(target: float = TARGET, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """The least number of bands with which a pair of that similarity collides with that probability: 1 - (1 - s^r)^b >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - target**rows))


def fold(text: str) -> str:
    t = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l")).casefold()
    return "".join(c for c in t if unicodedata.category(c) != "Mn" or not unicodedata.combining(c))


def parse_name(text: str) -> tuple[str, str, list[str], str, str]:
    """(kind, main, others, form, alternative): b for a body, p for a person.

    A body's main part is its own name, others are its common words. A person's main part is the surname, others are given names and
    initials in order. form tells how sure the roles are: sure, or free for two words without comma or initials, where alternative
    is the first word, which may be the surname.
    """
    folded = fold(text)
    words = [w for w in _TOKEN.findall(folded)]
    bare = [w.rstrip(".") for w in words]
    if any(w in BODY_WORDS for w in bare):
        head, comma, tail = folded.rpartition(",")
        own = [w.rstrip(".") for w in _TOKEN.findall(tail)] if comma else []
        rest = [w.rstrip(".") for w in _TOKEN.findall(head if comma else folded)]
        rest = [w for w in rest if w not in LINKING]
        if not own and rest:
            own, rest = rest[:1], rest[1:]
        return "b", " ".join(own), rest, "sure", ""
    left, comma, right = folded.partition(",")

    def parts(s: str) -> list[str]:
        return [t for t in _TOKEN.findall(s) if t.rstrip(".") not in TITLES or len(t.rstrip(".")) == 1]

    if comma:
        return "p", " ".join(t.rstrip(".") for t in parts(left)), [t.rstrip(".") for t in parts(right)], "sure", ""
    tokens = parts(folded)
    if not tokens:
        return "p", folded.strip(), [], "sure", ""
    short = [len(t.rstrip(".")) == 1 or t.endswith(".") and len(t) <= 3 for t in tokens]
    full = [i for i, s in enumerate(short) if not s]
    names = [t.rstrip(".") for t in tokens]
    if not full:
        return "p", "", names, "sure", ""
    if len(full) == 1:
        return "p", names[full[0]], [n for i, n in enumerate(names) if i != full[0]], "sure", ""
    if short[-1]:
        # "Surname I. I." with a surname of several words
        return "p", " ".join(names[i] for i in full), [n for i, n in enumerate(names) if short[i]], "sure", ""
    start = full[-1]
    while start - 1 > 0 and names[start - 1] in PARTICLES:
        start -= 1
    given = names[:start]
    return "p", " ".join(names[start:]), given, "free" if len(names) == 2 else "sure", names[0] if len(names) == 2 else ""


@lru_cache(200_000)
def one_edit(a: str, b: str) -> bool:
    """Whether a becomes b by one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and len(a[i : i + 2]) == 2 and a[i + 2 :] == b[i + 2 :]
    return a[i:] == b[i + 1 :]


@lru_cache(200_000)
def within_edits(a: str, b: str, k: int) -> bool:
    """Whether a becomes b by 1 to k insertions, deletions, substitutions or swaps of neighbours."""
    if k == 1:
        return one_edit(a, b)
    if a == b or abs(len(a) - len(b)) > k:
        return False
    # rows of the distance table, within k of the diagonal
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [k + 1] * len(b)
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != b[j - 1]))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > k:
            return False
        before, last = last, row
    return last[-1] <= k


def formal(name: str) -> tuple[str, ...]:
    return FORMAL.get(name, ()) + (name,)


def token_similarity(a: str, b: str, edits: int = EDITS) -> float:
    """1 for equal tokens; less for an everyday form, an initial or a beginning, and few edits; 0 for others."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) <= 2:
        short, long = sorted((a, b), key=len)
        return 0.95 if any(f.startswith(short) for f in formal(long)) else 0.0
    if set(formal(a)) & set(formal(b)):
        return 0.97
    if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)) and abs(len(a) - len(b)) > 1:
        return 0.93
    if min(len(a), len(b)) >= 4 and within_edits(a, b, edits):
        return 0.92
    for x, y in ((a, b), (b, a)):
        if any(f != x and len(y) >= 4 and within_edits(f, y, edits) for f in formal(x)):
            return 0.91
    return 0.0


def shortened(a: str, b: str) -> float:
    """Similarity of the common words of bodies: also letters left out, as in dept for department."""
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and len(long) - len(short) >= 2 and short[0] == long[0]:
        rest = iter(long)
        if all(c in rest for c in short):
            return 0.93
    return token_similarity(a, b)


def monge_elkan(a: list[str], b: list[str], similarity=token_similarity) -> float:
    """The mean over a's tokens of their best similarity among b's."""
    return sum(max(similarity(x, y) for y in b) for x in a) / len(a) if a and b else 0.0


def name_similarity(kind: str, main_a: str, others_a: list[str], main_b: str, others_b: list[str], edits: int = EDITS) -> float:
    """Monge-Elkan similarity of two parsed names, 0 where main parts, first given names or further initials speak against each other."""
    main = 1.0 if main_a == main_b else 0.92 if min(len(main_a), len(main_b)) >= 4 and within_edits(main_a, main_b, edits) else 0.0
    if not main or not others_a or not others_b:
        return main if main and kind == "b" and not others_a and not others_b else 0.0
    if kind == "b":
        return (main + min(monge_elkan(others_a, others_b, shortened), monge_elkan(others_b, others_a, shortened))) / 2 if len(others_a) == len(others_b) else 0.0
    first = token_similarity(others_a[0], others_b[0], edits)
    if not first:
        return 0.0
    for x, y in zip(others_a[1:], others_b[1:], strict=False):
        if not token_similarity(x, y, edits):
            return 0.0
    short, long = sorted(([*others_a], [*others_b]), key=len)
    return (main + monge_elkan(short, long, lambda x, y: token_similarity(x, y, edits))) / 2
