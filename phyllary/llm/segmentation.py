"""Sentence boundaries by cascading tables of break and no-break rules (problem 10). Pure Python.

A rule is a pair of regular expressions, for what stands before a position and for what stands after it, with a verdict. Positions are
those behind a terminator and its closing marks. The tables are those of the language: for every script there is a cascade, for Latin
letters one a language. They are asked in order; the first rule that fits decides. Blank lines always break; other line breaks never do.

The language is the declared one (en, EN, eng and en-GB are the same), unless the words of a paragraph plainly are another language's;
paragraphs of which neither tells the language, and other scripts, take the tables of their script.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import regex

#: Codes of one language: two letters, and three.
CODES = {"eng": "en", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "lat": "la", "rus": "ru", "gre": "el", "ell": "el", "chi": "zh", "zho": "zh", "jpn": "ja", "jp": "ja", "kor": "ko", "tha": "th", "hin": "hi", "ara": "ar", "urd": "ur", "amh": "am"}
#: Frequent words by which a paragraph's language is told.
FREQUENT = {
    "en": "the of and to in is was we it he she they this that with from at on for are were by not had",
    "de": "der die das und ist nicht wir ein eine den dem von zu mit auf bei im am wurde sich des nach er es",
    "fr": "le la les et est un une des du dans nous au pour que qui avec ne pas sur il par sont été",
    "es": "el la los las y es un una de en que del se con por no al para está son lo su",
    "la": "et in ad est non cum ex prope sed ac ubi sunt vel ab leg inter alt sub",
}
#: Abbreviations of any language with Latin letters that no sentence ends with. Lower case, without final dot; also with a capital.
BOTANY = "herb leg coll det cf ca c var subsp ssp subg nothosp f fo sp al ined nom comb holo iso lecto para nr s"
#: The same for each language.
NEVER_LAST = {
    "en": "dr mr mrs ms messrs prof rev hon gen col capt lt sgt gov pres st mt mts ste mme mlle viz vs approx e.g i.e eg ie sect ser ed eds rd ave univ dept chap vols pls",
    "de": "dr prof hr fr nr abb taf s bd bde vgl z d u geb gest bzw sog evtl inkl exkl fasz hrsg verf st südl nördl östl westl nordl sudl ostl nordöstl nordwestl südöstl südwestl str ing dipl mag zit insb etw mt",
    "fr": "dr pr prof mme mlle mgr st ste figs p pp t vol pl env éd av bd réf dét mt",
    "es": "sr sra srta sres dr dra d da lic ing prof profa figs pág págs p pp núm nº vol ej aprox prov ed tel av n ee gral pbro fr sta sto mt",
    "la": "circ pag dr p vol mt",
    "ru": "т е д г-н г-жа проф акад доц см ср рис табл стр гл им ул обл р оз о пос дер ст н св напр ок собр опр",
    "el": "κ κα κος δρ καθ αρ εικ σελ βλ πρβλ π χ δηλ αγ τομ κεφ αριθ πιν",
}
#: Abbreviations before figures, and months; many of them are also words that a sentence may end with.
BEFORE_FIGURES = "no nos nr núm n fig figs abb tab taf p pp pág págs s vol vols bd km ch chap cap art fasz t pl pls sect ser env approx ca alt jan feb febr mar apr jun jul aug sep sept oct okt nov dec dez ene abr ago dic janv févr avr juil déc"
#: Units and closing words that may end a sentence: they do where a capital follows.
MAY_LAST = "etc al m km cm mm ft in yd hrs hr min sec a.m p.m am pm ped diam alt ill jr sr jun sen usw uff ff co inc ltd bc ad n.chr v.chr г гг др пр д тыс млн руб μ εκ χλμ κ.ά κ.λπ hrs uhr std"
#: Words that begin sentences and follow no initial.
STARTERS = "The It He She We They This That These Those There Its His Her Their Our You In On At By For From With But And When Where While After Before Not No Was Were Is Are Had"
#: Words before an ordinal number with a dot, and words that follow one.
ORDINAL_BEFORE = "am der die das dem den des im vom zum zur beim nach seit bis ab und ein eine einem einen einer jeder jede unser unsere sein seine ihr ihre dieser diese auf bei von mit"
ORDINAL_AFTER = "januar jänner februar märz april mai juni juli august september oktober november dezember jahrhundert jahrhunderts weltkrieg weltkriegs weltkrieges exkursion auflage tag tage tages woche monat jahr jh teil band kapitel klasse stock stufe mal etappe lager expedition sammlung"

TERMINATORS = "!?.…‼⁇⁈⁉。！？｡．।॥۔؟።፧፨"
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}ー々〆〇"
_BEHIND = rf"[{re.escape(TERMINATORS)}]+(?:[\"”’'»)\]}}」』）】》〉]|\s{{1,4}}»)*"
_GREEK, _THAI = re.compile("[\u0370-\u03ff\u1f00-\u1fff]"), re.compile("[\u0e01-\u0e5b]")
#: Terminators with what closes behind them (a closing guillemet may stand after a blank, as in French); in texts with Greek letters
#: also semicolons, and with Thai ones blanks between them.
CANDIDATES = {
    (greek, thai): re.compile(rf"(?P<t>{_BEHIND})" + (r"|(?P<semi>[;;])(?=\s|$)" if greek else "") + (r"|(?P<thai>(?<=[\u0e01-\u0e5b])[  ]+(?=[\u0e01-\u0e5b]))" if thai else ""))
    for greek in (False, True)
    for thai in (False, True)
}
_SEMI_AFTER = regex.compile(r"\s+[\p{Lu}«“\"(]|\s*$")
PARAGRAPH = re.compile(r"(?:\r\n?|\n| )[^\S\r\n]*(?:(?:\r\n?|\n| )[^\S\r\n]*)+| |\f")


@dataclass(frozen=True)
class Rule:
    """A verdict where both expressions fit: before ends at the position and reaches as far back as it likes in the sentence, or with
    whole to the sentence's start; after begins at the position (blanks included). last: the characters that can stand just before the
    position where before fits, none for any; blank: whether a blank must follow. They only say which positions the rule is tried at."""

    name: str
    breaks: bool
    before: regex.Pattern | None
    after: regex.Pattern | None
    whole: bool = False
    last: str = ""
    blank: bool = False

    def fits(self, text: str, start: int, at: int, end: int) -> bool:
        if self.after is not None and self.after.match(text, at, end) is None:
            return False
        if self.before is None:
            return True
        if start and not text[start - 1].isspace():
            # what stands before the sentence is not looked at
            text, start, at = text[start:at], 0, at - start
        return (self.before.fullmatch if self.whole else self.before.match)(text, start, at) is not None


def _rule(name: str, breaks: bool, before: str = "", after: str = "", whole: bool = False, last: str = "") -> Rule:
    # what stands before is matched from the position backwards
    first = regex.compile(before, 0 if whole else regex.REVERSE) if before else None
    return Rule(name, breaks, first, regex.compile(after) if after else None, whole, last or ("." if before.endswith(r"\.") else ""), after.startswith(r"\s+"))


def _words(text: str) -> str:
    return "|".join(regex.escape(w) for w in sorted(set(text.split()), key=lambda w: (-len(w), w)))


def _cased(text: str) -> str:
    """The words in small letters or with a capital; in capitals they are other things, such as codes and initials."""
    return _words(" ".join(f"{w} {w[0].upper()}{w[1:]}" if len(w) > 1 else w for w in text.split()))


def _never(words: str, figures: bool = True) -> list[Rule]:
    """No sentence ends with these; in capitals only among words in capitals or before a figure."""
    return [
        _rule("abbreviation that never ends", False, rf"(?<![\p{{L}}\p{{N}}.])(?:{_cased(words)})\."),
        _rule("abbreviation in capitals", False, rf"(?<![\p{{L}}\p{{N}}.])(?:{_words(words.upper())})\.", r"\s+(?:\p{N}|\p{Lu}{2})"),
    ]


_MAY = r"(?<![\p{L}])(?i:" + _words(MAY_LAST) + r")\."
_CLOSE = r"[\"”“’'»)\]}」』）】]"
_OPEN = r"[\"“„«‘'(\[{¿¡—–-]"
#: Blanks, then marks that open, then a capital, a digit or a letter without case.
_START = rf"\s+(?:{_OPEN}\s?)*[\p{{Lu}}\p{{Lt}}\p{{N}}\p{{Lo}}]"

COMMON = [
    # what never parts
    _rule("inside a number or an address", False, r"[.:]", last=".:", after= r"[\p{L}\p{N}/_@%&=#~+-]*[/@]"),
    _rule("mark follows", False, "", r"\s*[,;:،؛、，；：·]"),
    _rule("closing mark follows", False, "", r"[\"”’»)\]}」』）】]"),
    _rule("terminator follows", False, "", rf"\s?[{regex.escape('!?…。！？')}]"),
    _rule("small letter follows", False, "", rf"\s*(?:[—–-]\s*)?(?:[\"“„«‘'(\[]\s?)*\p{{Ll}}"),
    _rule("dash and small letter follow", False, _CLOSE, r"\s*[—–-]\s*\p{Ll}", last="\"”“’'»)]}」』）】"),
    _rule("digits on both sides", False, r"\p{N}\.", r"\p{N}"),
]
_LATIN_FIRST = [
    _rule("height above sea, may end", True, r"\bm\s+(?:ü\.\s?M|s\.\s?n\.\s?m|a\.\s?s\.\s?l|s\.\s?m)\.", _START),
    _rule("time of day, may end", True, r"\d\s?[ap]\.\s?m\.", _START),
    _rule("of days and years, may end", True, r"\b(?:v|n)\.\s?Chr\.", _START),
    _rule("states, not at an end", False, r"\bEE\.(?:\s?UU\.)?", r"\s+(?:UU|[a-z])"),
    _rule("number word before a number", False, rf"(?<!\p{{L}})(?i:{_words(BEFORE_FIGURES)})\.", r"\s*(?:\p{N}|[IVXLC]+(?!\p{L}))"),
    _rule("short for and others, may end", True, r"\b(?:etc|usw|et\s+al|u\.\s?a|u\.\s?s\.\s?w)\.", _START),
    _rule("two letters with dots", False, r"(?<!\p{L})(?:z\.\s?B|d\.\s?h|u\.\s?a|i\.\s?e|e\.\s?g|p\.\s?ej|s\.\s?l|s\.\s?str|i\.\s?d\.\s?R|o\.\s?ä|s\.\s?n)\."),
]
_LATIN_LAST = [
    _rule("dotted letters before a word that begins sentences", True, r"(?<![\p{L}.])(?:\p{Lu}\.)+", rf"\s+(?:{_words(STARTERS)})(?![\p{{L}}.])"),
    _rule("initial", False, r"(?<![\p{L}\p{N}°'’])\p{Lu}\."),
    _rule("initial after an initial", False, r"(?<!\p{L})(?:\p{Lu}\.)+\p{Lu}\."),
    _rule("double initial", False, r"(?<!\p{L})(?:Ch|Th|Ph|Yu|Zh|Sh|Kh|Ts|Chr|Wm|Geo|Jos|Fr|Joh|Alex|Aug|Ferd|Gust|Herm)\.", r"\s+\p{Lu}"),
    _rule("numbered heading", False, r"\s*(?:\p{N}{1,3}|[IVXLC]{1,5}|\p{L})\.", whole=True),
    _rule("ordinal before a month or the like", False, r"(?<!\p{N}[.,]?)\b\p{N}{1,2}\.", rf"\s+(?i:{_words(ORDINAL_AFTER)})\b"),
    _rule("ordinal behind an article", False, rf"(?<!\p{{L}})(?i:{_words(ORDINAL_BEFORE)})\s+\p{{N}}{{1,2}}\.", r"\s+\p{Lu}"),
    _rule("unit or the like before a capital", True, _MAY, _START),
    _rule("capital follows", True, "", _START),
    _rule("lost blank before a capital", True, r"(?:\p{Ll}\p{Ll}|\p{N}|[)\]”\"»“’%°]|\p{Ll}\p{P})[.!?…]+[\"”’»)\]“]*", r"[\"“„«¿¡(]*\p{Lu}"),
    _rule("strong end, blank lost", True, r"[!?…][\"”’»)\]“]*", r"[¿¡«“„]*\p{Lu}"),
    _rule("dotted letters go on", False, r"\p{L}\.", r"\S"),
]
#: The abbreviations of each language, of two that a paragraph has words of, and without a language those of all.
ABBREVIATIONS = {k: f"{BOTANY} {NEVER_LAST[k]}" for k in FREQUENT}
ABBREVIATIONS |= {f"{a}+{b}": f"{ABBREVIATIONS[a]} {ABBREVIATIONS[b]}" for a in sorted(FREQUENT) for b in sorted(FREQUENT) if a < b}
ABBREVIATIONS[""] = " ".join([BOTANY, *(NEVER_LAST[k] for k in FREQUENT)])
#: One table each.
LATIN = {k: [*_LATIN_FIRST, *_never(words), *_LATIN_LAST] for k, words in ABBREVIATIONS.items()}
CYRILLIC = [
    _rule("year, may end", True, r"\p{N}\s*гг?\.", _START),
    _rule("and so on, may end", True, r"(?:и\s+)?т\.\s?[дп]\.", _START),
    _rule("and others, may end", True, r"и\s+(?:др|пр)\.", _START),
    _rule("town", False, r"(?<!\p{L})г\."),
    _rule("that is", False, r"(?<!\p{L})т\.(?:\s?е\.)?"),
    _rule("metres, may end", True, r"\p{N}\s*м\.", _START),
    *_never(NEVER_LAST["ru"]),
]
GREEK = [
    _rule("units and words that may end", True, r"(?:\p{N}\s*(?:μ|εκ|χλμ|χιλ|μμ)|κ\.\s?λπ|κ\.\s?ά|περ)\.", _START),
    *_never(NEVER_LAST["el"]),
    _rule("for example", False, r"(?<!\p{L})π\.\s?χ\."),
]
CJK = [
    _rule("ellipsis goes on", False, r"…+", rf"[{_CJK}\p{{L}}\p{{N}}]", last="…"),
    _rule("quotation goes on", False, r"[。！？…!?][」』”’》）)\"]+", r"\s*(?:と|って|という|とい|とか|など|は|が|を|に|の|も|で|へ|や|라고|이라고|하고|고)", last="」』”’》）)\""),
    _rule("who said it follows a quotation", False, r"(?s)\s*[“「『\"](?:(?![“”「」『』\"]).)*[。！？…!?]+[”」』\"]", rf"(?=[{_CJK}])[^。！？!?“”「」『』\n]{{0,24}}(?:说|道|喊|叫|问|答|写|曰|讲|說|問|寫|喊道)[^。！？!?“”「」『』]{{0,24}}[。！？!?]", whole=True, last="”』」\""),
    _rule("full stop of the script", True, r"[。！？｡．!?][」』”’》）)\"]*", rf"\s*(?:[“「『（(《\"]\s?)*[{_CJK}\p{{L}}\p{{N}}]"),
    _rule("ellipsis and blank", True, r"…+", r"\s", last="…"),
]
THAI = [
    _rule("repetition mark", False, "", r"\s*[ๆฯ]"),
    _rule("behind a repetition mark", False, r"[ๆฯ]"),
    _rule("beside a number", False, r"\p{N}\s*"),
]
OTHERS = [
    _rule("doctor, number and like words", False, r"(?<![\p{L}\p{M}])(?:د|أ|م|ص|ج|ط|डॉ|सं|प्रो|श्री|पृ|ले|ዶ|ሴ|ዓ|ኪ)\."),
    _rule("letters with dots", False, r"ሴ\.\s?ሜ\."),
    _rule("quotation goes on", False, r"[!?.][”\"’]", r"\s*(?:라고|이라고|하고|고|며)", last="”\"’"),
    _rule("end of the script", True, r"[।॥۔؟።፧፨!?…][\"”’»)\]]*"),
    _rule("dot of the script", True, r"[\p{L}\p{M}\p{N})\]\"”]\.[\"”’»)\]]*", r"\s+\S"),
]
DEFAULT = [_rule("anything follows", True, "", r"\s"), _rule("nothing decides", False)]

_SCRIPTS = [
    ("cjk", rf"[{_CJK}。！？｡．」』]"), ("cyr", r"\p{Cyrillic}"), ("el", r"\p{Greek}"), ("thai", r"\p{Thai}"), ("lat", r"\p{Latin}"),
    ("oth", r"[\p{Arabic}\p{Devanagari}\p{Ethiopic}\p{Hangul}\p{Bengali}\p{Hebrew}\p{Armenian}\p{Georgian}]"),
]
_SCRIPT_TESTS = [(name, regex.compile(p)) for name, p in _SCRIPTS]
#: The tables asked for each script of the letter before the position, in order; where Latin letters are among them, of each language.
CASCADE = {
    (script, language): table
    for language, latin in LATIN.items()
    for script, table in {
        "cjk": [*COMMON[1:4], *CJK, *COMMON[4:], *DEFAULT], "cyr": [*COMMON, *CYRILLIC, *latin, *DEFAULT], "el": [*COMMON, *GREEK, *latin, *DEFAULT], "thai": [*COMMON[1:4], *THAI, *latin, *DEFAULT],
        "lat": [*COMMON, *latin, *DEFAULT], "oth": [*COMMON[:4], *OTHERS, *COMMON[4:], *latin, *DEFAULT],
    }.items()
}


@lru_cache(4096)
def _tried(kind: str, language: str, last: str, blank: bool) -> tuple[Rule, ...]:
    """The rules of a cascade that can fit behind a character, before a blank or not, in order."""
    return tuple(r for r in CASCADE[kind, language] if (not r.last or last in r.last) and (blank or not r.blank))


@lru_cache(65_536)
def script(c: str) -> str:
    """The script of a character, "" for marks, figures and blanks."""
    return next((name for name, p in _SCRIPT_TESTS if p.match(c)), "")


@lru_cache(4096)
def language_code(lang: str | None) -> str:
    """The two letters of a language, whatever way it is written; "" for none or an unknown one."""
    first = re.split(r"[-_]", (lang or "").strip().lower())[0]
    code = CODES.get(first, first)
    return code if code in CODES.values() else ""


_POINTS = str.maketrans(dict.fromkeys(".,;:!?()[]«»“”„\"'’…", " "))
_FREQUENT = {w: tuple(k for k in FREQUENT if w in FREQUENT[k].split()) for words in FREQUENT.values() for w in words.split()}


def paragraph_language(text: str, declared: str) -> str:
    """The language with Latin letters of a paragraph, by its frequent words; such as only one language has count twice. The declared one,
    unless another is ahead by two: then that one, or both if the paragraph has words of both; "" if the declared one has none and no
    other two more than the rest."""
    counts = dict.fromkeys(FREQUENT, 0)
    for w in text.lower().translate(_POINTS).split():
        if ks := _FREQUENT.get(w):
            for k in ks:
                counts[k] += 3 - min(len(ks), 2)
    ranked = sorted(counts.values())
    best = max(counts, key=counts.get)
    if declared in counts and (counts[declared] or not ranked[-1]):
        if ranked[-1] < counts[declared] + 2:
            return declared
        return "+".join(sorted((best, declared))) if counts[declared] else best
    return best if ranked[-1] >= ranked[-2] + 2 else ""


#: Words that some rule speaks of; a plain end has none of them.
SPECIAL = frozenset(w for words in (BOTANY, *NEVER_LAST.values(), BEFORE_FIGURES, MAY_LAST, "ch th ph yu zh sh kh ts chr wm geo jos joh alex aug ferd gust herm περ χιλ μμ") for w in words.split())


#: Words that a rule about an end speaks of before the rules about abbreviations do.
_ENDS = frozenset("m a p al etc usw chr s u w".split())
_OFTEN_NEVER = {k: frozenset(words.split()) - _ENDS for k, words in ABBREVIATIONS.items()}
_OFTEN_FIGURES = frozenset(BEFORE_FIGURES.split()) - _ENDS
_STARTERS = frozenset(STARTERS.split())


def _at_once(paragraph: _Paragraph, start: int, at: int) -> bool | None:
    """The verdict of the tables where it is plain from a few characters; None where they must be asked. They would give the same: before
    a small letter (of scripts with capitals) and inside a number nothing breaks, nor behind an abbreviation or an initial; a common
    word's point or a strong mark before a blank and a capital does, and a full stop of a script before a letter of it."""
    text, end = paragraph.text, paragraph.end
    last = text[at - 1]
    if last not in ".!?":
        if last in "。！？" and at < end and text[at].isalpha() and script(text[at]) == "cjk":
            return True
        return True if last in "।።؟۔" and at + 1 < end and text[at] == " " and script(text[at + 1]) == "oth" and script(_last_letter(text, start, at)) == "oth" else None
    k = at
    while k < end and text[k].isspace():
        k += 1
    if k >= end:
        return None
    after, before = text[k], text[at - 2 : at - 1]
    if k == at:
        return False if last == "." and before.isdecimal() and after.isdecimal() and script(_last_letter(text, start, at)) in ("lat", "cyr", "el") else None
    if after.islower():
        return False if script(after) in ("lat", "cyr", "el") and script(_last_letter(text, start, at)) in ("lat", "cyr", "el") else None
    if not (figure := after.isdecimal()) and (not after.isupper() or script(after) not in ("lat", "cyr", "el")):
        return None
    if last != ".":
        return True if not figure and before.isalpha() and script(before) in ("lat", "cyr", "el") else None
    i = at - 1
    while i > start and text[i - 1].isalpha():
        i -= 1
    # a word behind a blank or an opening mark, in small letters or with a capital
    if i == at - 1 or i == start or not (text[i - 1].isspace() or text[i - 1] in "(«“„‘'\"") or (kind := script(text[at - 2])) not in ("lat", "cyr", "el"):
        return None
    word, low = text[i : at - 1], text[i : at - 1].lower()
    if low not in SPECIAL:
        if len(word) >= 3:
            return None if figure else True
        if len(word) == 1 and word.isupper() and kind == "lat" and word != "M" and not figure and script(after) == "lat":
            j = k
            while j < end and text[j].isalpha():
                j += 1
            return None if text[k:j] in _STARTERS or text[j : j + 1] == "." else False
        return None
    if kind != "lat" or word[1:] != low[1:] or len(word) == 1 and word != low:
        return None
    if figure and low in _OFTEN_FIGURES:
        return False
    return False if low in _OFTEN_NEVER[paragraph.language] and not (text[k : k + 1].isupper() and script(after) != "lat") else None


def _last_letter(text: str, start: int, at: int) -> str:
    """The last character before the position that tells a script, "" without any."""
    i = at - 1
    while i >= start:
        if script(text[i]):
            return text[i]
        i -= 1
    return ""


class _Paragraph:
    """A paragraph of a text: its language when it is asked for, and which of its places a bracket holds together."""

    def __init__(self, text: str, start: int, end: int, declared: str) -> None:
        self.text, self.start, self.end, self.declared = text, start, end, declared
        self._language: str | None = None
        # the outermost pairs of round brackets
        self.opened, self.closed, stack = [], [], []
        if text.find("(", start, end) >= 0 or text.find("（", start, end) >= 0:
            for m in _ROUND.finditer(text, start, end):
                if m[0] in "(（":
                    stack.append(m.start())
                elif stack:
                    o = stack.pop()
                    while self.opened and self.opened[-1] > o:
                        self.opened.pop()
                        self.closed.pop()
                    self.opened.append(o)
                    self.closed.append(m.start())

    @property
    def language(self) -> str:
        if self._language is None:
            self._language = paragraph_language(self.text[self.start : self.end], self.declared)
        return self._language

    def inside(self, start: int, at: int) -> bool:
        """Whether a pair of brackets that does not open the sentence is open at the position."""
        k = bisect_right(self.opened, at - 1) - 1
        return k >= 0 and self.closed[k] >= at and self.opened[k] >= start and self.text[start] not in "(（"

    def breaks(self, start: int, at: int) -> bool:
        """Whether a sentence that began at start ends at the position."""
        text, end = self.text, self.end
        if (verdict := _at_once(self, start, at)) is not None:
            return verdict
        kind = script(_last_letter(text, start, at)) or "lat"
        # Latin words and figures inside a text of another script take that script's rules
        if kind == "lat" and next((s for c in text[at:end] if (s := script(c))), "") == "cjk":
            kind = "cjk"
        language = self.language if kind == "lat" else ""
        for rule in _tried(kind, language, text[at - 1], text[at : at + 1].isspace()):
            if rule.fits(text, start, at, end):
                return rule.breaks
        return False


_ROUND = re.compile("[()（）]")


def _paragraphs(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in PARAGRAPH.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def _strip(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points, in order, without blanks at either end; none for a null or blank text.

    lang: the declared language, in any usual way of writing; null, unknown and wrong ones are fine.
    """
    if not text:
        return []
    out: list[tuple[int, int]] = []
    declared = language_code(lang)
    candidates = CANDIDATES[_GREEK.search(text) is not None, _THAI.search(text) is not None]
    for p, q in _paragraphs(text):
        p, q = _strip(text, p, q)
        if p == q:
            continue
        paragraph, start = _Paragraph(text, p, q, declared), p
        for m in candidates.finditer(text, p, q):
            at, how = m.end(), m.lastgroup
            # the German closing mark opens quotations elsewhere
            while at < q and text[at] == "“" and text.count("„", start, at) > text.count("“", start, at):
                at += 1
                while at < q and text[at] in "\"”’')]":
                    at += 1
            if at >= q or m.start() < start:
                continue
            if how == "thai":
                at = m.start()
                if any(r.fits(text, start, at, q) for r in THAI):
                    continue
            elif how == "semi":
                # the question mark of Greek
                if not _SEMI_AFTER.match(text, at, q):
                    continue
                found = script(_last_letter(text, start, m.start()))
                if not _GREEK.search(text, max(start, at - 40), at) or (found and found != "el" and not text[m.start() - 1].isdigit()):
                    continue
            elif not paragraph.breaks(start, at):
                continue
            if how != "thai" and paragraph.inside(start, at):
                continue
            a, b = _strip(text, start, at)
            if a < b:
                out.append((a, b))
            start = _strip(text, at, q)[0]
        a, b = _strip(text, start, q)
        if a < b:
            out.append((a, b))
    return out
