"""Lookups with a default: countries, skills, trust of sources, reliability of methods."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from confluo.functions.text import collapse, let, strip

#: Country names and codes (fixed values).
COUNTRIES = {
    "us": "US", "usa": "US", "u.s.": "US", "u.s.a.": "US", "united states": "US", "united states of america": "US", "america": "US",
    "in": "IN", "india": "IN",
    "uk": "GB", "u.k.": "GB", "united kingdom": "GB", "great britain": "GB", "gb": "GB",
    "ca": "CA", "canada": "CA", "de": "DE", "germany": "DE", "fr": "FR", "france": "FR", "au": "AU", "australia": "AU",
}
#: Trust of sources (fixed values).
TRUST = {"ats_json": 0.85, "recruiter_csv": 0.80, "github_api": 0.70, "github": 0.70, "resume": 0.60, "recruiter_notes": 0.50}
#: Reliability of extraction methods (fixed values).
RELIABILITY = {"structured": 1.0, "derived": 1.0, "regex": 0.8, "free-text": 0.5}
DEFAULT = 0.5
#: Used where the vocabulary file can't be read (fixed values).
FALLBACK_SKILLS = {
    "reactjs": "React", "react.js": "React", "react js": "React", "js": "JavaScript", "javascript": "JavaScript", "ts": "TypeScript",
    "typescript": "TypeScript", "k8s": "Kubernetes", "kubernetes": "Kubernetes", "py": "Python", "python": "Python", "golang": "Go", "go": "Go",
    "nodejs": "Node.js", "node.js": "Node.js", "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "docker": "Docker", "aws": "AWS", "rust": "Rust",
}
_VOCABULARY = Path(__file__).resolve().parent.parent / "data" / "skills.json"


def _mapped(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def normalize_country(c: Column) -> Column:
    """ISO 3166 alpha-2 code of a known name or code, else null."""
    return _mapped(COUNTRIES, strip(collapse(F.lower(strip(c)))))


def skill_vocabulary(path: str | Path | None = None) -> dict[str, str]:
    """Canonical skill by key; of aliases with the same key the last one counts."""
    try:
        payload = json.loads(Path(path or _VOCABULARY).read_text(encoding="utf-8"))
        aliases = payload.get("aliases", payload)
        aliases = {str(k).lower(): str(v) for k, v in aliases.items()}
    except (OSError, ValueError, TypeError, AttributeError):
        aliases = FALLBACK_SKILLS
    return {re.sub("[^a-z0-9]+", "", k.strip()): v for k, v in aliases.items()}


def skill_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "")


def normalize_skill(c: Column, vocabulary: dict[str, str] | None = None) -> Column:
    """Canonical name of a known skill, else the trimmed text."""
    return F.coalesce(_mapped(vocabulary or skill_vocabulary(), skill_key(c)), strip(c))


def is_allowed_skill(c: Column, vocabulary: dict[str, str] | None = None) -> Column:
    vocabulary = vocabulary or skill_vocabulary()
    return F.coalesce(let(normalize_skill(c, vocabulary), lambda x: (x != "") & x.isin(*sorted(set(vocabulary.values())))), F.lit(False))


def source_trust(c: Column) -> Column:
    return F.coalesce(_mapped(TRUST, c), F.lit(DEFAULT))


def method_reliability(c: Column) -> Column:
    return F.coalesce(_mapped(RELIABILITY, c), F.lit(DEFAULT))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def field_confidence(winners: Column, supplying: Column, method: Column) -> Column:
    """0.5 * mean trust + 0.3 * share of the supplying sources + 0.2 * reliability, added in this order; 0 without sources."""
    w = F.array_sort(F.array_distinct(winners))
    n = F.size(F.array_union(supplying, w))
    trust = F.when(F.size(w) > 0, F.aggregate(w, F.lit(0.0), lambda a, s: a + source_trust(s)) / F.size(w)).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(clamp01(F.lit(0.5) * trust + F.lit(0.3) * (F.size(w) / n) + F.lit(0.2) * method_reliability(method)))
