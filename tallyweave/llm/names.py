"""What a typed company name says: its own words, its trade, its holding company."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.tokens import DBA_PATTERN, LEGAL_FORMS, STAND_INS, feed_key, five_digits, state_code, ten_digits, web_host
from tallyweave.llm.pii import fold

# Trade words and the family they tell (0: none by itself).
TRADE_WORDS = {
    "fire": 1,
    "sprinkler": 1,
    "sprinklers": 1,
    "suppression": 1,
    "safety": 1,
    "life": 1,
    "alarm": 1,
    "alarms": 1,
    "detection": 1,
    "extinguisher": 1,
    "extinguishers": 1,
    "protection": 1,
    "inspection": 1,
    "inspections": 1,
    "testing": 1,
    "service": 0,
    "services": 0,
    "system": 0,
    "systems": 0,
    "equipment": 0,
    "contractor": 0,
    "contractors": 0,
    "mechanical": 2,
    "plumbing": 3,
    "electric": 4,
    "electrical": 4,
    "building": 5,
    "maintenance": 5,
}
# Usual short forms that are no subsequence, and initials of whole trades.
TRADE_SHORT = {"fes": 1, "fss": 1, "lss": 1, "fis": 1, "fe": 1, "fa": 1, "fp": 1, "ss": 1, "se": 1, "st": 1, "aad": 1, "ad": 1, "bm": 5}
TRADE_SHORT |= {"alm": 1, "det": 1, "ext": 1, "saf": 1, "spk": 1, "spr": 1, "sup": 1, "prt": 1, "ins": 1, "tst": 1, "eqp": 0, "svc": 0, "sys": 0, "mec": 2, "plb": 3, "elc": 4, "ele": 4, "bld": 5, "mnt": 5}
HOLDING_WORDS = frozenset({"enterprises", "group", "holdings", "partners", "ventures"})
STOP_WORDS = frozenset("the and of by for at in n s inc".split())
# Given names and their usual short forms.
GIVEN_SHORT = {
    "alexander": "alex al lex xander sandy sasha",
    "andrew": "andy drew",
    "anthony": "tony ant",
    "charles": "charlie chuck chas chip",
    "christopher": "chris topher kit",
    "deborah": "deb debbie debby",
    "edward": "ed eddie ned ted teddy",
    "elizabeth": "liz beth betty lizzie eliza bess libby",
    "eugene": "gene",
    "francisco": "paco pancho frank cisco kiko",
    "gerald": "gerry jerry",
    "henry": "hank harry hal",
    "james": "jim jimmy jamie",
    "john": "jack johnny jon",
    "joseph": "joe joey jos",
    "katherine": "kate kathy katie kat kitty kit kath",
    "lawrence": "larry lars laurie",
    "leonard": "leo len lenny",
    "margaret": "maggie peggy meg marge greta",
    "michael": "mike mick mickey mikey",
    "patricia": "pat patty trish tricia",
    "rebecca": "becky becca reba",
    "richard": "rick dick rich richie ricky",
    "robert": "bob rob bobby robbie bert",
    "samuel": "sam sammy",
    "stephen": "steve stevie steph",
    "susan": "sue susie suzy",
    "theodore": "ted teddy theo",
    "thomas": "tom tommy thom",
    "william": "bill will billy willie wm",
}
_GIVEN = frozenset(GIVEN_SHORT) | frozenset(s for short in GIVEN_SHORT.values() for s in short.split())
_INITIALS: dict[str, str] = {}
for _full, _short in GIVEN_SHORT.items():
    for _word in (_full, *_short.split()):
        _INITIALS[_word] = "".join(sorted({*_INITIALS.get(_word, ""), _full[0]}))
_LOOKALIKE = str.maketrans("013458", "oleash")
_DBA = re.compile(DBA_PATTERN)
_ALIAS = re.compile(r"\s*\(([^()]*)\)\s*\Z")
_TOKEN = re.compile(r"[a-z0-9]+")
_LEGAL = frozenset(LEGAL_FORMS)
_SPELLED_FORM = re.compile(r"(?:pllc|llc|llp|lp|pc)$")

OWN, TRADE, GIVEN, DROP = 0, 1, 2, 3


def _near(a: str, b: str, most: int) -> bool:
    """Whether at most ``most`` letters are inserted, dropped, changed or swapped with their neighbour."""
    if abs(len(a) - len(b)) > most:
        return False
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        if min(now) > most:
            return False
        before, row = row, now
    return row[-1] <= most


def _letters(s: str) -> int:
    m = 0
    for ch in s:
        m |= 1 << (ord(ch) & 31)
    return m


def _letter_pairs(s: str) -> int:
    """A bit for each pair of neighbouring letters, some sharing one; a change touches at most four, a swap six."""
    m = 0
    before = ord(s[0])
    for ch in map(ord, s[1:]):
        m |= 1 << ((before * 37 + ch) & 255)
        before = ch
    return m


_KNOWN: dict[int, list[tuple[str, int, int, int, int, int]]] = {}
for _word, _kind, _fam in [(w, TRADE, f) for w, f in TRADE_WORDS.items() if len(w) > 3] + [(w, GIVEN, 0) for w in GIVEN_SHORT if len(w) > 4]:
    for _n in range(len(_word) - 2, len(_word) + 3):
        if abs(_n - len(_word)) <= (_most := 1 if len(_word) < 7 else 2):
            _KNOWN.setdefault(_n, []).append((_word, _letters(_word), _letter_pairs(_word), _kind, _fam, _most))
def _shorts(word: str, most: int = 9) -> set[str]:
    """What is left of ``word`` if at least one letter but not the first is dropped, up to ``most`` letters."""
    out = {word[0]}
    for ch in word[1:]:
        out |= {s + ch for s in out if len(s) < most}
    return out - {word}


_SHORT: dict[str, int] = {}
for _word, _fam in TRADE_WORDS.items():
    for _form in _shorts(_word):
        _SHORT.setdefault(_form, _fam)


def _forms(t: str) -> Iterator[str]:
    """A short form as typed, and without one slip: a letter doubled or swapped, or, from five letters on, put in."""
    yield t
    for i in range(len(t) - 1):
        if t[i] == t[i + 1]:
            if (once := t[:i] + t[i + 1 :]) and (len(once) > 3 or once in TRADE_SHORT):
                yield once
        else:
            yield t[:i] + t[i + 1] + t[i] + t[i + 2 :]
    if 4 < len(t) < 8:
        for i in range(1, len(t)):
            yield t[:i] + t[i + 1 :]


@lru_cache(maxsize=200_000)
def token_class(t: str) -> tuple[int, int]:
    """(class, trade family) of one lower-case word."""
    if t in TRADE_WORDS:
        return TRADE, TRADE_WORDS[t]
    if t in STOP_WORDS or t in _LEGAL or len(t) == 1:
        return DROP, 0
    if t in TRADE_SHORT:
        return TRADE, TRADE_SHORT[t]
    if t in _GIVEN:
        return GIVEN, 0
    if 4 <= len(t) <= 9:
        for form in _forms(t):
            if form in _SHORT:
                return TRADE, _SHORT[form]
    if len(t) >= 3:
        own, pairs = _letters(t), None
        for w, mask, theirs, kind, fam, most in _KNOWN.get(len(t), ()):
            if (own ^ mask).bit_count() <= 2 * most:
                if pairs is None:
                    pairs = _letter_pairs(t)
                if (pairs ^ theirs).bit_count() <= 6 * most and _near(t, w, most):
                    return kind, fam
    return OWN, 0


class Parsed(NamedTuple):
    """Own words in order, trade family (0 unknown), whether a holding word stands in it, initials of given names."""

    own: tuple[str, ...]
    family: int
    holding: bool
    initials: str


_NONE = Parsed((), 0, False, "")


def parse_part(text: str) -> Parsed:
    """One printed name without a trading-name wording."""
    words = _TOKEN.findall(text.replace("'s ", " ").replace("'", "").replace(".", " ") if "'" in text or "." in text else text)
    own: list[str] = []
    initials: set[str] = set()
    family, holding, i = 0, False, 0
    while i < len(words):
        t = words[i]
        if len(t) == 1 and i + 1 < len(words) and len(words[i + 1]) == 1:
            j = i
            while j < len(words) and len(words[j]) == 1:
                j += 1
            t, i = _SPELLED_FORM.sub("", "".join(words[i:j])), j
            if not t or (len(t) < 4 and token_class(t)[0] == OWN):
                continue
        else:
            i += 1
        if not t.isalpha():
            if t.isdigit():
                continue
            t = t.translate(_LOOKALIKE)
        if t in HOLDING_WORDS:
            holding = True
            continue
        kind, fam = token_class(t)
        if kind == OWN:
            own.append(t)
        elif kind == GIVEN:
            initials.update(_INITIALS.get(t, t[0]))
        elif len(t) == 1 and t not in "fs":
            initials.add(t)
        elif fam > family:
            family = fam
    return Parsed(tuple(own), family, holding, "".join(sorted(initials)))


def parse_name(name: str | None, dba: str | None = None) -> tuple[Parsed, Parsed]:
    """(trading name, holding company) of a record; either may be empty.

    Stand-ins, blanks and generic names without a word of their own give nothing.
    """
    trading, legal = _NONE, _NONE
    if name:
        s = (name if name.isascii() else fold(name)).lower()
        parts = _DBA.split(s, 1)
        if len(parts) == 1 and "(" in s and (m := _ALIAS.search(s)) and m.group(1):
            parts = [s[: m.start()], m.group(1)]
        if " ".join(_TOKEN.findall(s)) not in STAND_INS:
            legal = parse_part(parts[0])
            if len(parts) > 1:
                trading = parse_part(parts[1])
            elif not legal.holding:
                trading, legal = legal, _NONE
    if dba:
        d = (dba if dba.isascii() else fold(dba)).lower()
        if " ".join(_TOKEN.findall(d)) not in STAND_INS:
            second = parse_part(d)
            if not trading.own:
                trading = second
    return trading, legal if legal.holding else _NONE


def ordered(own: tuple[str, ...]) -> tuple[str, str]:
    """Own words as two parts in alphabetical order; split or joined words come as one part."""
    if not own:
        return "", ""
    if len(own) == 2:
        a, b = sorted(own)
        return (a, b) if len(a) > 3 and len(b) > 3 else ("".join(own), "")
    if len(own) > 2:
        # fragments of up to four letters belong to a neighbour
        words = list(own)
        while len(words) > 2:
            k = min(range(len(words)), key=lambda i: len(words[i]))
            left = k - 1 if k and (k + 1 == len(words) or len(words[k - 1]) <= len(words[k + 1])) else k
            words[left : left + 2] = ["".join(words[left : left + 2])]
        a, b = sorted(words)
        return a, b
    return own[0], ""


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, fam, hold, ini = [], [], [], [], []
        for name, dba in zip(batch.column("name").to_pylist(), batch.column("dba").to_pylist()):
            trading, legal = parse_name(name, dba)
            x, y = ordered(trading.own)
            a.append(x)
            b.append(y)
            fam.append(trading.family)
            hold.append(" ".join(sorted(legal.own)) or None)
            ini.append(sum(1 << (ord(x) - 97) for x in trading.initials))
        keep = [i for i, n in enumerate(batch.schema.names) if n not in ("name", "dba")]
        cols = [batch.column(i) for i in keep] + [pa.array(a), pa.array(b), pa.array(fam, pa.int8()), pa.array(hold, pa.string()), pa.array(ini, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, [batch.schema.names[i] for i in keep] + ["w1", "w2", "fam", "hold", "ini"])


def parsed_records(records: DataFrame) -> DataFrame:
    """``rid, feed, state, zip5, phone, host, w1, w2, fam, hold, ini`` of every record row.

    ``w1, w2`` are the name's own words (empty for a stand-in, a blank or a generic
    name), ``fam`` its trade family (0 unknown), ``hold`` the words of a holding
    company, ``ini`` the initials of given names in full or short form, a bit for each letter. Null or unusable fields are null.
    """
    rows = records.select(
        F.col("record_id").alias("rid"),
        feed_key("source").alias("feed"),
        state_code("state").alias("state"),
        five_digits("zip").alias("zip5"),
        ten_digits("phone").alias("phone"),
        web_host("website").alias("host"),
        "name",
        "dba",
    )
    return rows.mapInArrow(_parsed, "rid string, feed string, state string, zip5 string, phone string, host string, w1 string, w2 string, fam byte, hold string, ini int")


def parsed_spellings(spellings: DataFrame) -> DataFrame:
    """``rid, w1, w2, fam, ini`` of typed names (``rid, name``)."""
    rows = spellings.select("rid", "name", F.lit(None).cast("string").alias("dba"))
    return rows.mapInArrow(_parsed, "rid string, w1 string, w2 string, fam byte, hold string, ini int").drop("hold")
