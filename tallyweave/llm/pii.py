"""Personal information in free text: find it, and replace it by typed placeholders.

A text passes through character and phrase transducers (homoglyphs and accents,
zero-width characters, spelled-out digits, at/dot disguises). Identifiers are
detected in the normalised text and every span is mapped back to the characters
of the source, which are returned or replaced. Whole texts are processed, in one
pass, row by row; nothing is shuffled before mentions are made distinct.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "phone", "id_number", "address", "person")

# Common given names, folded to ASCII.
GIVEN = """
Adaeze Alexander Amara Anders Andrew Anthony Charles Christopher Deborah Delphine Dmitri Edward Elizabeth Eugene
Francisco Freya Gerald Henry Hiro Ines Ivo James John Joseph Katherine Keoni Kwame Lawrence Leonard Linh Lucia
Marek Margaret Mateo Michael Mireille Noor Oksana Patricia Priya Rebecca Richard Robert Rohan Samuel Saoirse Soren
Stephen Susan Tariq Theodore Thomas Tomasz William Wren Ximena Yusuf Zoe
Mary David Jennifer Linda Barbara Jessica Sarah Karen Daniel Matthew Mark Donald Steven Paul Joshua Kenneth Kevin Brian
George Timothy Ronald Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Larry Justin Scott Brandon Benjamin Gregory
Nancy Lisa Betty Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Laura Cynthia Angela Maria Jose Carlos
Ahmed Mohamed Fatima Wei Ling Chen Anna Peter Hans Julia Ana Luis Juan Pedro Sofia Elena Ivan Olga Piotr Lars Ingrid
""".split()

# Words that, right after a person's name, make it the name of a firm or street.
FIRM_WORDS = """
fire sprinkler sprinklers suppression safety life alarm alarms plumbing mechanical electric electrical building equipment
inspection extinguisher extinguishers protection security heating roofing holdings group partners ventures enterprises
street avenue road boulevard lane drive court pike parkway terrace way place mutual supply council trust depot yard hall
works mill heights falls mills station county school library llc inc corp ltd company services systems testing
""".split()

TITLES = r"(?:Mrs|Mr|Ms|Mx|Dr|Prof|Rev|Hon)"
DIGIT_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}

_FOLD = {}
for _cp in range(0x80, 0x250):
    _base = unicodedata.normalize("NFKD", chr(_cp))[0]
    if _base.isascii() and _base.isprintable():
        _FOLD[_cp] = _base
# Letters without a decomposition, look-alike letters, widths and dashes; all one to one.
_FOLD |= {ord(a): b for a, b in zip("øØłŁđĐıßæÆœŒ", "oOlLdDisaAoO")}
_FOLD |= {ord(a): b for a, b in zip("аАеЕоОрРсСхХуУіІТМНКВ", "aAeEoOpPcCxXyYiITMHKB")}
_FOLD |= {ord(a): b for a, b in zip("αοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aoABEZHIKMNOPTYX")}
_FOLD |= {0x2018: "'", 0x2019: "'", 0x02BC: "'", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2014: "-", 0x2212: "-", 0xFE63: "-"}
_FOLD |= {cp: " " for cp in (0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x200A, 0x202F, 0x3000)}
_FOLD |= {cp: chr(cp - 0xFEE0) for cp in range(0xFF01, 0xFF5F)}

_WORDS = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"\b(?:{_WORDS})(?:[\s,-]{{1,3}}(?:{_WORDS})){{6,14}}\b", re.I)
_WORD = re.compile(rf"{_WORDS}", re.I)
_DISGUISE = re.compile(r"\s*[\[({]\s*(?:at|dot|@|\.)\s*[\])}]\s*|\s+at\s+(?=[A-Za-z0-9-]+\s+dot\s)|\s+dot\s+(?=[A-Za-z])|[​-‍⁠﻿­]", re.I)

_AT = re.compile("@")
_LOCAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*\Z|[A-Za-z0-9]\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_DIGITS = re.compile(r"[+(\d][\d() \t./+-]{7,}\d")
_PHONE = re.compile(r"(?<![\w@#.+/-])(?<!\d[ ])(?:\+?1(?:[ \t]?[.-][ \t]?|[ \t]{1,2}|(?=\())?)?(?:\([2-9]\d\d\)[ \t]{0,2}|[2-9]\d\d[ \t]{0,2}[./-]?[ \t]{0,2})\d{3}[ \t]{0,2}[.-]?[ \t]{0,2}\d{4}(?![\w@-]|\.\d)")
# a country prefix other than 1, then eight to fourteen digits in groups
_ABROAD = re.compile(r"(?<![\w@#.+/-])\+(?=(?:[ \t()./-]*\d){9,15}(?!\d))[2-9]\d{0,2}(?:[ \t]?[./-]?[ \t]?(?:\(\d{1,5}\)|\d{2,})){2,6}(?![\w@-])")
_LABEL = re.compile(
    r"\b(?:ssn|social\s+security(?:\s+(?:number|no\.?|card))?|soc\.?\s*sec|taxpayer\s+id(?:entification)?|tax\s+id|itin|tin|passport|driver'?s?'?\s+licen[cs]e|dl)\b\.?(?:\s*(?:number|no\.?|num\.?|id))?(?:\s+(?:is|was|reads|ist|es))?\s*[#:]*\s*"
    r"(?P<v>\d{3}[ -]\d{2}[ -]\d{4}|\d{9}|[A-Z]{1,2}\d{3}[ -]\d{4}[ -]\d{4}|[A-Z]{1,2}\d{6,13})(?![\w-])",
    re.I,
)
_LABEL_GATE = ("ssn", "social s", "soc. s", "soc s", "taxpayer", "tax id", "itin", " tin", "passport", "s licen", "r licen", "dl#", "dl ", "dl:")
_UNIT = r"(?:,?\s(?:Suite|Ste\.?|Unit|Apt\.?|Apartment|Room|Rm\.?|Floor|Bldg\.?)\s?#?\w+\b|,?\s\#\s?\w+\b)?"
_TYPE = r"(?:Street|Avenue|Road|Boulevard|Lane|Drive|Court|Pike|Parkway|Terrace|Way|Place|Circle|Trail|Highway|Square|(?:St|Ave|Rd|Blvd|Ln|Dr|Ct|Pkwy|Ter|Pl|Cir|Trl|Hwy|Sq)\b\.?)"
_DIR = r"(?:(?:North|South|East|West|NE|NW|SE|SW|[NSEW])\.?\s)?"
_ROUTE = r"(?:County\sRoad|County\sHighway|State\sRoute|State\sRoad|Rural\sRoute|US\sHighway|U\.S\.\sHighway|Highway|Hwy\.?|Route|CR|SR)\s\d+\w?"
_ADDRESS = re.compile(rf"\d{{1,6}}+[A-Z]?+(?:\s1/2)?+\s{_DIR}(?:{_ROUTE}\b|(?:[A-Z][\w'-]++|\d++(?:st|nd|rd|th))(?:\s(?!{_TYPE}(?!\w))[A-Z][\w'-]++)?+\s{_TYPE}(?!\w)){_UNIT}", re.I)
_CLOSES = re.compile(r"\.(?:\s*$|\s+[A-Z\"(<#*-])")

_SUR = r"(?:(?:van|de|der|von|la|del|VAN|DE|DER|VON|LA|DEL)\s){0,2}(?:Mc|Mac|MC|MAC|O')?[A-Z][A-Za-z']*[A-Za-z](?:-[A-Z][A-Za-z']+)?"
_CAPITAL = re.compile(r"[A-Z][A-Za-z]+")
_AFTER_GIVEN = re.compile(rf"\s(?:[A-Z]\.\s?)?(?P<s>{_SUR})(?![\w'-])")
_BEFORE_GIVEN = re.compile(rf"(?:\A|(?<=[^\w'-]))(?P<s>{_SUR}),\s\Z")
_MIDDLE = re.compile(r"\s[A-Z]\.(?=\W)")
_SURNAME_NEXT = re.compile(r" (?:[A-Z]\. )?(?:van |de |Mc|O')?[A-Z][a-z]{4,}")
_INITIAL = re.compile(rf"[A-Z]\.\s?(?:[A-Z]\.\s?)?(?P<s>{_SUR})(?![\w'-])")
_FULL = rf"(?:[A-Z][a-z]+|[A-Z]\.)\s(?:[A-Z]\.\s)?(?P<s>{_SUR})(?![\w'-])"
_TITLED = re.compile(rf"{TITLES}\.?\s(?P<n>{_FULL})")
_TITLE_GATE = ("Mr", "Ms", "Mx ", "Dr.", "Dr ", "Prof", "Rev", "Hon")
# Wordings after which a person is named.
_CUES = (
    "Contact on site:",
    "Key holder:",
    "For the bond file:",
    "Signed,",
    "Please call",
    "Spoke with",
    "Lead from",
    "Applicant",
    "attention",
    "beside the name",
    "Ansprechpartner ist",
    "pregunte por",
    "Llame a",
    "Bitte",
)
_CUED = re.compile(rf"\s+(?:{TITLES}\.?\s)?(?P<n>{_FULL}|(?P<t>{_SUR}),\s[A-Z][a-z]{{2,}}(?=\s?[,/;.\n]))")
_PAIR = re.compile(r"(?<![\w'&-])(?P<g>[A-Z][a-z]{2,})\s(?:[A-Z]\.\s?)?(?P<s>(?:Mc|Mac|O')?[A-Z][a-z]{2,}(?:-[A-Z][a-z]+)?)(?![\w'-])")
# Roles and labels before a person's name.
_ROLES = "contact|attn|attention|manager|owner|supervisor|technician|inspector|foreman|tenant|caretaker|signed|name|by|from|with|call|ask for|reach"
_ROLE = re.compile(rf"\b(?:{_ROLES})\b", re.I)
_ROLE_END = re.compile(rf"\b(?:{_ROLES})\s*[:,]?\s+(?:{TITLES}\.?\s)?\Z", re.I)
_REACH = re.compile(r"\s*[,(<:;-]{0,2}\s*(?:(?:at|on|tel|phone|cell|mobile|email|e-mail)\.?:?\s*)?(?:\(?\+?\d[\d() .-]{8,}\d|[\w.+-]+@[\w-]+\.)", re.I)
_NEXT = re.compile(r"(?:\s*&\s*|\s+and\s+|,?\s+)?([A-Za-z]+)")
_NOT_SURNAME = frozenset(
    "The This That Whether Roughly Between Please Hotline Pressure Revenue Deficiency Invoices Owner Under Tag Item Fee Meter Two Our Mail Ask Permit"
    " Spoke Signed Subject After However Meanwhile Separately Contact Key Applicant Lead Reach Write Forwarded Cash Background No Ship For By As On In"
    " From And With Street Avenue Heights Falls Mills Station Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May"
    " June July August September October November December Re Llame Bitte Someone Only Since When Because Valve Dealers Inspectors Auditors".split()
)


MOST_SURNAME = 256  # characters of a surname printed before a given name
_DIGIT_GATE = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "oh")


def _gate(text: str) -> bool:
    """Whether an at/dot disguise can stand in the text."""
    return any(g in text for g in (" dot ", " DOT ", " Dot ", "at)", "at]", "at }", "at ]", "at )", "AT)", "AT]", "At)", "At]", "(@", "[@", "[.", "(."))


_FOREIGN = re.compile(r"[^\x00-\x7f]")


def fold(text: str) -> str:
    """Accents, look-alike letters, dashes and wide forms to ASCII, one character for one."""
    for ch in set(_FOREIGN.findall(text)):
        if new := _FOLD.get(ord(ch)):
            text = text.replace(ch, new)
    return text


class Source:
    """A normalised text with the way back to its source."""

    __slots__ = ("raw", "norm", "at_norm", "at_raw", "ends")

    def __init__(self, raw: str):
        self.raw = raw
        text = raw if raw.isascii() else fold(raw)
        edits: list[tuple[int, int, str]] = []
        if not text.isascii() or _gate(text):
            for m in _DISGUISE.finditer(text):
                word = m.group(0).strip(" \t\n\r[](){}").lower()
                edits.append((m.start(), m.end(), "@" if word in ("at", "@") else "." if word in ("dot", ".") else ""))
        low = text.lower()
        if sum(map(low.count, _DIGIT_GATE)) > 6:
            for m in _SPELLED.finditer(text):
                inner = [(m.start() + w.start(), m.start() + w.end(), w.group(0)) for w in _WORD.finditer(m.group(0))]
                edits += [(x, y, DIGIT_WORDS[w.lower()]) for x, y, w in inner]
                edits += [(u[1], v[0], "") for u, v in zip(inner, inner[1:])]
        if not edits:
            self.norm, self.at_norm = text, None
            return
        edits.sort()
        out, n, pos = [], 0, 0
        self.at_norm, self.at_raw, self.ends = [], [], []
        for a, b, new in edits:
            if a < pos:
                continue
            if a > pos:
                self.at_norm.append(n)
                self.at_raw.append(pos)
                self.ends.append(True)
                out.append(text[pos:a])
                n += a - pos
            if new:
                self.at_norm.append(n)
                self.at_raw.append(a)
                self.ends.append(b)
                out.append(new)
                n += 1
            pos = b
        self.at_norm.append(n)
        self.at_raw.append(pos)
        self.ends.append(True)
        out.append(text[pos:])
        self.norm = "".join(out)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Source offsets of the normalised span [a, b)."""
        if self.at_norm is None:
            return a, b
        i = bisect.bisect_right(self.at_norm, a) - 1
        start = self.at_raw[i] + (a - self.at_norm[i] if self.ends[i] is True else 0)
        j = bisect.bisect_right(self.at_norm, b - 1) - 1
        end = self.at_raw[j] + (b - self.at_norm[j]) if self.ends[j] is True else self.ends[j]
        return start, end


def _firm_follows(text: str, end: int) -> bool:
    m = _NEXT.match(text, end, end + 40)
    return bool(m) and m.group(1).lower() in _FIRM


_FIRM = frozenset(FIRM_WORDS)


def _people(t: str, addresses: list[str]) -> Iterator[tuple[int, int]]:
    """Names of persons. ``Surname, Given`` goes before ``Given Surname`` unless a surname follows the given name."""
    taken: list[tuple[int, int]] = []
    heads: list[tuple[int, int]] = []
    for a, b in _given_names(t):
        if (a and (t[a - 1].isalnum() or t[a - 1] in "'-")) or t[b : b + 1].isalnum() or t[b : b + 1] in ("'", "-"):
            continue
        before = _BEFORE_GIVEN.search(t[max(0, a - MOST_SURNAME) : a])
        if before and before.group("s") and not _SURNAME_NEXT.match(t, b):
            s = before.group("s")
            if s.split("-")[0].title() not in _NOT_SURNAME and s.title() not in _GIVEN_SET and not _firm_follows(t, b):
                middle = _MIDDLE.match(t, b)
                taken.append((max(0, a - MOST_SURNAME) + before.start("s"), middle.end() if middle else b))
                continue
        after = _AFTER_GIVEN.match(t, b)
        if after and _is_surname(after.group("s")) and not _firm_follows(t, after.end()):
            heads.append((a, after.end()))
    for m in _INITIAL.finditer(t):
        a, b = m.span()
        if a and (t[a - 1].isalnum() or t[a - 1] in ".'&-" or t[max(0, a - 2) : a] == ". " and t[max(0, a - 3) : a - 2].isupper()):
            continue
        if _is_surname(m.group("s")) and not _firm_follows(t, b):
            heads.append((a, b))
    if any(g in t for g in _TITLE_GATE):
        for m in _TITLED.finditer(t):
            if _is_surname(m.group("s")) and not _firm_follows(t, m.end("n")):
                heads.append(m.span("n"))
    for cue in _CUES:
        at = t.find(cue)
        while at >= 0:
            m = _CUED.match(t, at + len(cue))
            if m and _is_surname(m.group("s") or m.group("t")) and not _firm_follows(t, m.end("n")):
                heads.append(m.span("n"))
            at = t.find(cue, at + len(cue))
    heads += [span for span in _told_by_context(t, addresses) if span not in heads]
    yield from taken
    starts = [a for a, _ in taken]
    for a, b in heads:
        i = bisect.bisect_right(starts, a) - 1
        if i < 0 or taken[i][1] <= a:
            yield a, b


def _told_by_context(t: str, addresses: list[str]) -> Iterator[tuple[int, int]]:
    """Names that no list holds, scored by what stands around them.

    Two capitalised words count as a person's name with two points: two for an
    e-mail address of the text whose local part is made of them, one for a role or a
    label before them, one for a phone number or an address right behind them.
    """
    if not addresses and not _ROLE.search(t):
        return
    locals_ = [re.sub("[^a-z]", " ", a.lower()).split() for a in addresses]
    joined = {"".join(words) for words in locals_}
    at = 0
    while m := _PAIR.search(t, at):
        at = m.start("s")
        given, surname = m.group("g"), m.group("s")
        if not _is_surname(surname) or not _is_surname(given) or _firm_follows(t, m.end()):
            continue
        g, s = given.lower(), re.sub("[^a-z]", "", surname.lower())
        own = bool({g + s, s + g, g[0] + s, s + g[0]} & joined) or any(s in words and (g in words or g[0] in words) for words in locals_)
        role = bool(_ROLE_END.search(t[max(0, m.start() - 40) : m.start()]))
        reach = bool(_REACH.match(t, m.end()))
        if 2 * own + role + reach >= 2:
            at = m.end()
            yield m.span()


def _given_names(t: str) -> list[tuple[int, int]]:
    """Where given names stand, in order."""
    found = []
    for g in _GIVEN_FORMS.intersection(_CAPITAL.findall(t)):
        at = t.find(g)
        while at >= 0:
            found.append((at, at + len(g)))
            at = t.find(g, at + len(g))
    return sorted(found)


def _is_surname(s: str) -> bool:
    return s.title() not in _NOT_SURNAME and s.lower() not in _FIRM


_GIVEN_FORMS = frozenset(GIVEN) | frozenset(g.upper() for g in GIVEN)
_GIVEN_SET = frozenset(GIVEN)


def mentions(raw: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in source characters, by position, not overlapping. Null and empty texts have none."""
    if not raw:
        return []
    src = Source(raw)
    t = src.norm
    found: list[tuple[int, int, str]] = []
    for m in _AT.finditer(t):
        begin = m.start()
        while begin and (t[begin - 1].isalnum() or t[begin - 1] in "._%+-"):
            begin -= 1
        left = _LOCAL.search(t[begin : m.start()])
        right = _DOMAIN.match(t, m.end())
        if left and right:
            a = m.start() - (len(left.group(0)))
            found.append((a, right.end(), "email"))
    low = t.lower()
    if any(g in low for g in _LABEL_GATE):
        found += [(*m.span("v"), "id_number") for m in _LABEL.finditer(t) if any(ch.isdigit() for ch in m.group("v"))]
    for run in _DIGITS.finditer(t):
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(t, *run.span())]
        if "+" in run.group(0):
            found += [(m.start(), m.end(), "phone") for m in _ABROAD.finditer(t, *run.span())]
    for m in _ADDRESS.finditer(t):
        a, b = m.span()
        if a and (t[a - 1].isalnum() or t[a - 1] in "_#$.,/-"):
            continue
        if t[b - 1] == "." and t[b : b + 1] != "." and _CLOSES.match(t, b - 1):
            b -= 1
        found.append((a, b, "address"))
    for a, b in _people(t, [t[a:b].split("@")[0] for a, b, _ in found if _ == "email"]):
        found.append((a, b, "person"))
    order = {k: i for i, k in enumerate(KINDS)}
    found.sort(key=lambda x: (x[0], order[x[2]], -x[1]))
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in found:
        if kept and a < kept[-1][1]:
            if order[kind] < order[kept[-1][2]]:
                kept.pop()
            else:
                if kind == kept[-1][2] and b > kept[-1][1] and a == kept[-1][0]:
                    kept[-1] = (a, b, kind)
                continue
        kept.append((a, b, kind))
    return [(*src.span(a, b), kind) for a, b, kind in kept]


def redact(raw: str | None) -> str | None:
    """The text with every mention replaced by ``[KIND]``; the rest stays as it is."""
    if not raw:
        return raw
    out, pos = [], 0
    for a, b, kind in mentions(raw):
        out += [raw[pos:a], f"[{kind.upper()}]"]
        pos = b
    return "".join([*out, raw[pos:]])


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, kinds, values = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = {(kind, text[a:b]) for a, b, kind in mentions(text)}
            for kind, value in sorted(seen):
                ids.append(key)
                kinds.append(kind)
                values.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(kinds, pa.string()), pa.array(values, pa.string())], [batch.schema.field(0).name, "kind", "value"])


def find_personal_information(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, kind, value``: each distinct mention of each text, exactly as printed.

    ``key`` must be unique; null or empty texts give no rows. Whole texts are read.
    """
    kind_of_key = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_found, f"`{key}` {kind_of_key}, kind string, value string")


def _redacted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        new = pa.array([redact(t) for t in batch.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), new], [batch.schema.field(0).name, batch.schema.field(1).name])


def redact_personal_information(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text`` with typed placeholders; null texts stay null."""
    kind_of_key = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_redacted, f"`{key}` {kind_of_key}, `{text}` string")
