"""Run settings: plain frozen records read from YAML and checked on the driver."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

import yaml

from tallyweave.functions.names import ABBREVIATIONS, US_STATES, normalize_name


class TallyError(Exception):
    """Any failure a run reports; ``code`` is the exit status."""

    code = 1


class SpecError(TallyError):
    """Settings or inputs that cannot be used."""

    code = 2


class LineageError(TallyError):
    """Claims that don't stand on their evidence."""


# Business words that don't tell one company from another.
GENERIC_WORDS = frozenset(
    "service system solutions group contractor company holdings enterprises associates brothers partners industries national international technology management equipment".split()
)


def _check(ok: bool, text: str) -> None:
    if not ok:
        raise SpecError(text)


@dataclass(frozen=True)
class Linkage:
    """Scores of record pairs, 0 to 100, and the words behind them."""

    merge_at: float = 92.0
    review_at: float = 80.0
    phone_bonus: float = 8.0
    site_bonus: float = 8.0
    zip_bonus: float = 3.0
    state_penalty: float = 15.0
    slack: float = 15.0
    cohesion_floor: float = 70.0
    most_in_block: int = 200
    prefix: int = 3
    generic: frozenset[str] = GENERIC_WORDS
    abbreviations: Mapping[str, str] = field(default_factory=lambda: dict(ABBREVIATIONS))

    def __post_init__(self):
        _check(0 <= self.review_at <= self.merge_at <= 100, "linkage: 0 <= review_at <= merge_at <= 100")
        _check(self.most_in_block >= 2 and self.prefix >= 1, "linkage: most_in_block from 2, prefix from 1")
        _check(min(self.phone_bonus, self.site_bonus, self.zip_bonus, self.state_penalty, self.slack) >= 0, "linkage: points must not be negative")


@dataclass(frozen=True)
class Sizing:
    """How statements of size become ranges."""

    z: float = 1.96
    least_sigma: float = 0.15
    mode: str = "endpoints"
    open_factor: float = 3.0
    conflict_factor: float = 1.25
    headcount: tuple[float, float] = (0.85, 1.25)
    per_location: tuple[float, float] = (6.0, 25.0)
    per_technician: tuple[float, float] = (1.25, 4.0)
    weights: Mapping[str, float] = field(default_factory=lambda: {"band": 1.0, "headcount": 0.9, "technicians": 0.6, "locations": 0.5})
    floor_spread: float = 1.5

    def __post_init__(self):
        _check(self.z > 0 and self.least_sigma > 0, "sizing: z and least_sigma must be positive")
        _check(self.mode in ("endpoints", "independent"), "sizing: mode is endpoints or independent")


@dataclass(frozen=True)
class Ranking:
    """Weights of the composite score and the cut of the first tier."""

    weight_p: float = 0.45
    weight_fit: float = 0.25
    weight_hidden: float = 0.20
    weight_evidence: float = 0.10
    first_ranks: int = 12
    least_p: float = 0.40
    sources_for_full: int = 3
    credit: Mapping[str, float] = field(default_factory=lambda: {"high": 1.0, "medium": 0.65, "low": 0.35})

    def __post_init__(self):
        weights = (self.weight_p, self.weight_fit, self.weight_hidden, self.weight_evidence)
        _check(min(weights) >= 0 and sum(weights) > 0, "ranking: weights must not be negative, nor all zero")
        _check(self.first_ranks >= 1 and self.sources_for_full >= 1, "ranking: counts from 1")
        _check(0 <= self.least_p <= 1, "ranking: least_p between 0 and 1")


@dataclass(frozen=True)
class Segment:
    name: str
    keywords: tuple[str, ...] = ()


@dataclass(frozen=True)
class Sector:
    """Keyword lists that place a company in a sector and its segments."""

    include: tuple[str, ...] = ()
    adjacent: tuple[str, ...] = ()
    residential: tuple[str, ...] = ()
    naics: tuple[str, ...] = ()
    segments: tuple[Segment, ...] = ()
    recurring: tuple[str, ...] = ()
    install: tuple[str, ...] = ()
    name_weight: float = 0.5
    dominance: float = 2.0
    fit: Mapping[str, float] = field(default_factory=lambda: {"A": 1.0, "B": 0.75, "C": 0.4, "D": 0.0})

    def __post_init__(self):
        _check(set(self.fit) == set("ABCD"), "sector: fit needs A, B, C and D")
        _check(all(0 <= v <= 1 for v in self.fit.values()), "sector: fit between 0 and 1")


@dataclass(frozen=True)
class Feed:
    feed: str
    adapter: str
    trust: float = 0.5
    options: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        _check(bool(self.feed) and bool(self.adapter), "feed: name and adapter are required")
        _check(0 <= self.trust <= 1, f"feed {self.feed}: trust between 0 and 1")


@dataclass(frozen=True)
class Database:
    database: str
    checker: str
    weight: float = 1.0

    def __post_init__(self):
        _check(self.weight >= 0, f"database {self.database}: weight must not be negative")


@dataclass(frozen=True)
class Visibility:
    match_at: float = 90.0
    confirmed_at: float = 95.0
    site_weight: float = 0.10
    hidden_below: float = 0.30
    databases: tuple[Database, ...] = ()

    def __post_init__(self):
        names = [d.database for d in self.databases]
        _check(len(names) == len(set(names)), "visibility: a database is listed twice")


@dataclass(frozen=True)
class Spec:
    """One complete run."""

    name: str
    feeds: tuple[Feed, ...]
    sector: Sector = Sector()
    states: tuple[str, ...] = ()
    linkage: Linkage = Linkage()
    sizing: Sizing = Sizing()
    ranking: Ranking = Ranking()
    visibility: Visibility = Visibility()
    top_n: int = 10

    def __post_init__(self):
        _check(bool(self.name), "name is required")
        _check(bool(self.feeds), "at least one feed is required")
        names = [f.feed for f in self.feeds]
        _check(len(names) == len(set(names)), "a feed is listed twice")
        _check(all(s in US_STATES for s in self.states), "states are two-letter codes")
        _check(self.top_n >= 1, "top_n from 1")


_NESTED = {"sector": Sector, "linkage": Linkage, "sizing": Sizing, "ranking": Ranking, "visibility": Visibility}
_LISTS = {"feeds": Feed, "segments": Segment, "databases": Database}


def _build(kind: type, raw: Any, where: str) -> Any:
    _check(isinstance(raw, Mapping), f"{where}: a mapping is needed")
    known = {f.name for f in fields(kind)}
    unknown = sorted(set(raw) - known)
    _check(not unknown, f"{where}: unknown {', '.join(map(str, unknown))}")
    values: dict[str, Any] = {}
    for k, v in raw.items():
        if k in _NESTED:
            values[k] = _build(_NESTED[k], v, k)
        elif k in _LISTS:
            _check(isinstance(v, list), f"{where}.{k}: a list is needed")
            values[k] = tuple(_build(_LISTS[k], x, f"{where}.{k}") for x in v)
        elif k == "generic":
            values[k] = GENERIC_WORDS | frozenset(map(str, v))
        elif k == "abbreviations":
            values[k] = dict(ABBREVIATIONS) | {str(a): str(b) for a, b in v.items()}
        else:
            values[k] = tuple(v) if isinstance(v, list) else v
    try:
        return kind(**values)
    except TypeError as e:
        raise SpecError(f"{where}: {e}") from None


def spec_from_mapping(raw: Mapping[str, Any]) -> Spec:
    return _build(Spec, raw, "spec")


def spec_from_yaml(text: str) -> Spec:
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise SpecError(f"not readable as YAML: {e}") from None
    return spec_from_mapping(raw or {})


def load_spec(path: str | Path) -> Spec:
    try:
        return spec_from_yaml(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise SpecError(f"cannot read {path}: {e}") from None


def demo_spec() -> Spec:
    """The packaged example: fire and life safety over the listed feeds."""
    return load_spec(Path(__file__).with_name("demo.yaml"))


def with_synthetic(spec: Spec, seed: int, firms: int) -> Spec:
    """The same run over generated feeds of this seed and size."""
    _check(firms >= 1, "firms from 1")
    feeds = tuple(replace(f, adapter="synthetic", options={"seed": seed, "firms": firms}) for f in spec.feeds)
    return replace(spec, feeds=feeds)


__all__ = ["normalize_name", "Spec", "SpecError", "LineageError", "TallyError", "load_spec", "demo_spec", "spec_from_yaml", "spec_from_mapping", "with_synthetic"]
