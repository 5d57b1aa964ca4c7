"""Typed values mapped to entries of a reference list (problem 7): a trie of spellings and aliases searched with a Levenshtein automaton."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllary.session import arrow_function

#: Entries up to which the trie is built on the driver and sent to every worker; the lists served are vocabularies, not data.
LIST_ROWS = 500_000
#: Words written short in names of places and bodies.
SHORT_WORDS = {
    "univ": "university", "nat": "natural", "hist": "history", "bot": "botanic", "gard": "garden", "acad": "academy", "sci": "sciences", "mus": "museum", "roy": "royal",
    "inst": "institute", "soc": "society", "natl": "national", "int": "international", "isl": "islands", "is": "islands", "rep": "republic", "st": "saint", "prov": "province", "distr": "district", "dist": "district", "div": "division", "dept": "department",
}
#: What may stand before or behind a listed spelling, in folded words.
BEFORE = {
    "country": ["republic of", "the republic of", "kingdom of", "state of", "the"],
    "state_province": ["province", "province of", "state of", "the", "prov"],
    "institution_code": ["herb", "herbarium", "the"],
}
BEHIND = {
    "country": ["republic of", "republic", "kingdom of", "mainland"],
    "state_province": ["province", "state"],
    "institution_code": ["herbarium", "herb"],
}

_PUNCT = re.compile(r"[^\w-]+|_|(?<!\w)-|-(?!\w)")


def allowed(length: int) -> int:
    """Edits allowed for a folded text of that length: codes and very short words must be exact."""
    return 0 if length <= 4 else 1 if length < 12 else 2


def fold(text: str) -> str:
    """Lower case without accents, marks as blanks, short words written out, single blanks."""
    t = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l")).casefold()
    t = "".join(c for c in t if unicodedata.category(c) != "Mn" or unicodedata.combining(c) == 0)
    return _PUNCT.sub(" ", t).strip()


def _long(folded: str, text: str) -> str:
    """The folded text with words written out that stand with a dot in the text."""
    short = {fold(w) for w in re.findall(r"(?<![^\W\d_])([^\W\d_]+)\.", text)}
    return " ".join(SHORT_WORDS.get(w, w) if w in short else w for w in folded.split())


class Automaton:
    """The Levenshtein automaton of a word for up to k edits (insertion, deletion, substitution, swap of neighbours).

    A state is a set of (letters of the word read, edits, whether a swap is half done).
    """

    def __init__(self, word: str, k: int) -> None:
        self.word, self.k, self.n = word, k, len(word)
        self.start = self._close({(0, 0, False)})

    def _close(self, state: set) -> frozenset:
        todo = list(state)
        while todo:
            i, e, half = todo.pop()
            if not half and i < self.n and e < self.k and (x := (i + 1, e + 1, False)) not in state:
                state.add(x)
                todo.append(x)
        return frozenset(state)

    def step(self, state: frozenset, c: str) -> frozenset:
        out, w, n, k = set(), self.word, self.n, self.k
        for i, e, half in state:
            if half:
                if w[i] == c:
                    out.add((i + 2, e, False))
                continue
            if i < n and w[i] == c:
                out.add((i + 1, e, False))
            if e < k:
                out.add((i, e + 1, False))
                if i < n:
                    out.add((i + 1, e + 1, False))
                if i + 1 < n and w[i + 1] == c != w[i]:
                    out.add((i, e + 1, True))
        return self._close(out)

    def distance(self, state: frozenset) -> int | None:
        return min((e + self.n - i for i, e, half in state if not half and e + self.n - i <= self.k), default=None)


class Trie:
    """Spellings with the entries they stand for."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, entry: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(entry)

    def exact(self, word: str) -> set[int]:
        node = self.root
        for c in word:
            node = node.get(c)
            if node is None:
                return set()
        return node.get("", set())

    def begins(self, stem: str) -> set[int]:
        """Entries of all words that begin with the stem."""
        node = self.root
        for c in stem:
            node = node.get(c)
            if node is None:
                return set()
        out: set[int] = set()
        todo = [node]
        while todo:
            for c, child in todo.pop().items():
                if c == "":
                    out |= child
                else:
                    todo.append(child)
        return out

    def near(self, word: str, k: int) -> dict[int, int]:
        """Every entry within k edits of the word, with its least distance."""
        out: dict[int, int] = {}
        a = Automaton(word, k)
        todo = [(self.root, a.start)]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "":
                    if (d := a.distance(state)) is not None:
                        for entry in child:
                            out[entry] = min(d, out.get(entry, d))
                elif new := a.step(state, c):
                    todo.append((child, new))
        return out


class Reference:
    """The reference list: tries by kind, parents, listed spellings."""

    def __init__(self, rows: Iterable[tuple]) -> None:
        self.tries: dict[str, Trie] = defaultdict(Trie)
        self.parent: dict[int, int | None] = {}
        self.listed: dict[int, str] = {}
        for entry, kind, name, code, parent, aliases in rows:
            self.parent[entry] = parent
            self.listed[entry] = (code if kind == "institution_code" else name) or ""
            for text in [name, code, *(re.split(r"[|;]", aliases) if aliases else [])]:
                if text and (f := fold(text)):
                    self.tries[kind].add(f, entry)
        self.memo: dict = {}

    def _variants(self, kind: str, text: str) -> list[str]:
        """The folded text and what is left of it without usual additions, likeliest first."""
        base = fold(text)
        out = [base, _long(base, text)]
        joined = base.replace(" ", "")
        if kind == "institution_code" and re.fullmatch(r"\s*(?:\w\s*\.\s*)+\w?\s*", text):
            out.append(joined)
        for t in list(dict.fromkeys(out)):
            for b in BEFORE.get(kind, []):
                if t.startswith(b + " "):
                    out.append(t[len(b) + 1 :])
            for b in BEHIND.get(kind, []):
                if t.endswith(" " + b):
                    out.append(t[: -len(b) - 1])
        return [t for t in dict.fromkeys(out) if t]

    def find(self, kind: str, text: str) -> dict[int, int]:
        """Every entry that the text may mean, with its distance; exact readings shut out inexact ones."""
        if (key := (kind, text)) in self.memo:
            return self.memo[key]
        trie, variants = self.tries[kind], self._variants(kind, text)
        found: dict[int, int] = {}
        for t in variants:
            if not found:
                found = dict.fromkeys(trie.exact(t), 0)
        if not found and variants and len(variants[0]) >= 4 and text.rstrip().endswith("."):
            # cut short with a dot: the beginning of one entry only
            begun = trie.begins(variants[0])
            found = dict.fromkeys(begun, 0) if len(begun) == 1 else {}
        if not found:
            for t in variants:
                for entry, d in trie.near(t, allowed(len(t))).items():
                    found[entry] = min(d, found.get(entry, d))
            best = min(found.values(), default=0)
            found = {e: d for e, d in found.items() if d == best}
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[key] = found
        return found

    def within(self, kind: str, text: str) -> dict[int, int]:
        """Every entry within the distance that the text's length allows, with its least distance, whatever is nearer."""
        found: dict[int, int] = {}
        for t in self._variants(kind, text):
            for entry, d in self.tries[kind].near(t, allowed(len(t))).items():
                found[entry] = min(d, found.get(entry, d))
        return found

    def resolve(self, kind: str, text: str, owner: str | None, owner_kind: str = "country") -> tuple[int | None, int | None, str]:
        """(entry, distance, status): status is exact (as listed), mapped, none (entry 0) or ambiguous (entry null)."""
        found, own = self.find(kind, text), None
        if kind == "state_province":
            head, comma, tail = text.rpartition(",")
            own = self.find(owner_kind, tail) if comma and tail.strip() else None
            if own and (inner := self.find(kind, head)):
                found = {e: d for e, d in inner.items() if self.parent[e] in own} or found or inner
            elif len(found) > 1 and owner and owner.strip():
                own = self.find(owner_kind, owner)
            if own and len(found) > 1:
                found = {e: d for e, d in found.items() if self.parent[e] in own} or found
        if not found:
            return 0, None, "none"
        if text in (self.listed[e] for e in found):
            return (next(iter(found)) if len(found) == 1 else None), 0, "exact"
        if len(found) > 1:
            return None, None, "ambiguous"
        entry, d = next(iter(found.items()))
        return entry, d, "mapped"


def load_reference(entries: DataFrame, rows: int = LIST_ROWS) -> list[tuple]:
    """The list's rows on the driver, at most rows of them (a longer one is an error: it would be no vocabulary)."""
    got = entries.select("entry_id", "kind", "entry_name", "entry_code", "parent_id", "aliases").limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"the reference list has more than {rows} entries")
    return [tuple(r) for r in got]


_worker: dict = {}


def resolver(spark, entries: list[tuple]):
    """A vectorised function (kind, text, owner) -> struct(entry_id, distance, status, listed); each worker builds the tries once."""
    sent, token = spark.sparkContext.broadcast(entries), uuid.uuid4().hex

    def resolve(kind: pd.Series, text: pd.Series, owner: pd.Series) -> pd.DataFrame:
        if _worker.get("token") != token:
            _worker.update(token=token, reference=Reference(sent.value))
        reference, memo, out = _worker["reference"], {}, []
        for key in zip(kind, text, owner, strict=True):
            if key not in memo:
                memo[key] = reference.resolve(*key) if key[1] and key[1].strip() else (None, None, "blank")
            out.append(memo[key])
        frame = pd.DataFrame(out, columns=["entry_id", "distance", "status"])
        frame["listed"] = [reference.listed.get(e) for e, _, _ in out]
        return frame.astype({"entry_id": "Int64", "distance": "Int32"})

    return arrow_function(resolve, "struct<entry_id:long,distance:int,status:string,listed:string>")


def entries_within(df: DataFrame, text: str, kind: str, entries: DataFrame) -> DataFrame:
    """One row for each row of df and entry within the distance that the text's length allows: df's columns, entry_id, distance (least
    over the entry's spellings and aliases). Texts without any entry, null and blank ones have no row; repeated rows stay; the new
    columns replace any of the same names. One vectorised pass, no shuffle."""
    df = df.drop("entry_id", "distance")
    sent, token = df.sparkSession.sparkContext.broadcast(load_reference(entries)), uuid.uuid4().hex

    def search(texts: pd.Series) -> pd.Series:
        if _worker.get("token") != token:
            _worker.update(token=token, reference=Reference(sent.value))
        memo: dict = {}
        for t in texts:
            if t not in memo:
                memo[t] = sorted(_worker["reference"].within(kind, t).items()) if t and t.strip() else []
        return pd.Series([[{"entry_id": e, "distance": d} for e, d in memo[t]] for t in texts], dtype=object)

    found = arrow_function(search, "array<struct<entry_id:long,distance:int>>")(F.col(text).cast("string"))
    return df.withColumn("__e", F.explode(found)).select(*df.columns, F.col("__e.entry_id").alias("entry_id"), F.col("__e.distance").alias("distance"))


def map_to_list(df: DataFrame, fields: dict[str, str], entries: DataFrame, owner: str | None = None) -> DataFrame:
    """One row for each row of df and field: df's columns, field_name, field_text, entry_id, distance, map_status.

    fields: column -> kind of the list. entry_id is the entry meant, 0 without any, null where several entries fit equally well
    (map_status ambiguous) or the field is blank or null (blank). map_status exact: the text is the listed spelling; mapped: it
    differs. owner names the column with the owning entry's text (the country of a state). Repeated rows stay; the new columns replace
    any of the same names; an empty df gives none. One vectorised pass over the rows, no shuffle; hot values are found once a batch.
    """
    df = df.drop("field_name", "field_text", "entry_id", "distance", "map_status")
    resolve = resolver(df.sparkSession, load_reference(entries))
    items = F.array(*[F.struct(F.lit(c).alias("field_name"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("field_text")) for c, k in fields.items()])
    rows = df.withColumn("__f", F.explode(items))
    own = F.col(owner).cast("string") if owner else F.lit(None).cast("string")
    # only a state's meaning depends on its owner: others share one memo entry
    own = F.when(F.col("__f.kind") == "state_province", own)
    rows = rows.withColumn("__m", resolve(F.col("__f.kind"), F.col("__f.field_text"), own))
    return rows.select(*df.columns, F.col("__f.field_name").alias("field_name"), F.col("__f.field_text").alias("field_text"), F.col("__m.entry_id").alias("entry_id"), F.col("__m.distance").alias("distance"), F.col("__m.status").alias("map_status"))
