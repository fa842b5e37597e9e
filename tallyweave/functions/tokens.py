"""Column expressions that bring hand-typed fields to comparable forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wordings that stand in for a missing value.
STAND_INS = (
    "",
    "n a",
    "na",
    "name not provided",
    "no name",
    "none",
    "not provided",
    "null",
    "see file",
    "tbd",
    "unknown",
)

# Legal forms, dots removed.
LEGAL_FORMS = (
    "co",
    "company",
    "corp",
    "corporation",
    "inc",
    "incorporated",
    "limited",
    "llc",
    "llp",
    "lp",
    "ltd",
    "pc",
    "plc",
    "pllc",
)

# Wordings that introduce a trading name.
ALIAS_WORDINGS = ("d/b/a", "d.b.a", "dba", "doing business as", "a/k/a", "a.k.a", "aka", "t/a", "trading as")


def loosely(wordings: tuple[str, ...]) -> str:
    """A pattern of the wordings that lets blanks stand around slashes and behind dots, and any white space between words."""
    loose = {"/": r"\s*/\s*", ".": r"\.\s*", " ": r"\s+"}
    return "|".join("".join(loose.get(ch, ch) for ch in w) for w in wordings)


DBA_PATTERN = rf"(?i)[\s,;]+(?:{loosely(ALIAS_WORDINGS)})\.?:?\s+"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squash(x: Column | str) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one blank."""
    return F.trim(F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", " "))


def feed_key(x: Column | str) -> Column:
    """Feed names without case, outer blanks and kind of word separator."""
    return F.regexp_replace(F.lower(F.trim(c(x))), r"[\s_-]+", "_")


def is_stand_in(x: Column | str) -> Column:
    """True for null, blank and wordings that stand in for a missing value."""
    return F.coalesce(squash(x).isin(*STAND_INS), F.lit(True))


def ten_digits(x: Column | str) -> Column:
    """The ten digits of a dialable line, else null.

    A leading country 1 and an extension don't count; the first of the ten is
    neither 0 nor 1. Lines in usual punctuation need one pattern only.
    """
    plain = F.translate(c(x), " ()-./+", "")
    usual = F.when(plain.rlike("^1?[2-9][0-9]{9}$"), F.right(plain, F.lit(10)))
    bare = F.regexp_replace(F.lower(c(x)), r"\s*(?:x|ext\.?|extension|#)\s*\d+\s*$", "")
    ten = F.regexp_replace(F.regexp_replace(bare, r"\D", ""), r"^1(?=\d{10}$)", "")
    return F.coalesce(usual, F.when(ten.rlike(r"^[2-9]\d{9}$"), ten))


def web_host(x: Column | str) -> Column:
    """Host name of an address as people write it, without ``www.``; else null."""
    before = r"(?:[a-z][a-z0-9+.-]*://)?+(?:[^/?#]*@)?+\.*+(?:www\.)?+"
    after = r"\.*(?::\d*)?(?:[/?#].*)?"
    host = F.regexp_extract(F.lower(F.trim(c(x))), rf"(?s)^{before}([a-z0-9-]+(?:\.[a-z0-9-]+)+){after}$", 1)
    return F.nullif(host, F.lit(""))


def five_digits(x: Column | str) -> Column:
    """First five digits of a postal code, null if fewer or all five equal."""
    head = F.substring(c(x), 1, 5)
    d = F.when(head.rlike("^[0-9]{5}$"), head).otherwise(F.substring(F.regexp_replace(c(x), r"\D", ""), 1, 5))
    return F.when((F.length(d) == 5) & (d != F.repeat(F.substring(d, 1, 1), F.lit(5))), d)


def legal_part(x: Column | str) -> Column:
    """The name before a trading-name wording or a closing bracketed alias."""
    s = F.regexp_replace(F.trim(c(x)), DBA_PATTERN + ".*$", "")
    return F.trim(F.regexp_replace(s, r"\s*\([^()]*\)\s*$", ""))


def ends_in_legal_form(x: Column | str) -> Column:
    """True if the last word, dots removed, is a legal form."""
    s = F.regexp_replace(F.lower(c(x)), r"\.", "")
    last = F.regexp_extract(s, r"([a-z]+)[\s,;]*$", 1)
    return F.coalesce(last.isin(*LEGAL_FORMS), F.lit(False))


STATE_NAMES = {
    "illinois": "IL",
    "ohio": "OH",
    "michigan": "MI",
    "missouri": "MO",
    "indiana": "IN",
    "wisconsin": "WI",
    "minnesota": "MN",
    "iowa": "IA",
    "kansas": "KS",
    "nebraska": "NE",
    "tennessee": "TN",
    "kentucky": "KY",
    "south dakota": "SD",
    "north dakota": "ND",
    "pennsylvania": "PA",
    "west virginia": "WV",
}


def state_code(x: Column | str) -> Column:
    """Two-letter code; full state names are looked up, blanks give null."""
    s = F.lower(F.trim(c(x)))
    table = F.create_map(*[F.lit(v) for kv in STATE_NAMES.items() for v in kv])
    return F.nullif(F.coalesce(F.element_at(table, s), F.upper(s)), F.lit(""))
