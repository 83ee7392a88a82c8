"""The saved search: a dict checked on the driver and compiled to columns elsewhere."""

from __future__ import annotations

import math
import re

from ..constants import (
    ATS_KEYS, BAND_CEILING, BAND_FLOOR, COMPANY_SIZE_BANDS, DEFAULT_WEIGHTS, DEGREES, EMPLOYMENT_TYPES, JOB_FUNCTIONS,
    PAY_PERIODS, REMOTE_SCOPES, SECTORS, SENIORITY_LEVELS, SORTS, UNKNOWABLE_CRITERIA, UNKNOWN_POLICIES, WORKPLACE_TYPES,
)

# field -> (allowed values or None, how each entry is normalised)
LIST_FIELDS = {
    "title_keywords": (None, str), "description_keywords": (None, str), "exclude_title_keywords": (None, str),
    "exclude_description_keywords": (None, str), "companies": (None, str), "ats": (ATS_KEYS, str),
    "company_size": ([b[0] for b in COMPANY_SIZE_BANDS], str), "sectors": (list(SECTORS), str),
    "exclude_sectors": (list(SECTORS), str), "metros": (None, str.lower), "countries": (None, str.lower),
    "workplace": ([w for w in WORKPLACE_TYPES if w != "unknown"], str), "remote_scope": (REMOTE_SCOPES, str),
    "employment_type": ([t for t in EMPLOYMENT_TYPES if t != "Unknown"], str), "job_functions": (JOB_FUNCTIONS, str),
    "skills": (None, str.lower), "exclude_skills": (None, str.lower),
    "seniority": ([s for s in SENIORITY_LEVELS if s != "unknown"], str), "pay_period": (PAY_PERIODS, str.upper),
    "degree": (DEGREES, str),
}
CHOICES = {"title_match": ["any", "all"], "description_match": ["any", "all"], "skills_match": ["any", "all"]}
FLAGS = [
    "include_unlisted", "remote_counts_as_match", "include_intern", "requires_equity", "salary_stated_only",
    "exclude_visa_refusal", "exclude_clearance", "collapse_duplicates",
]
NUMBERS = ["max_years_experience", "min_years_experience", "salary_min", "salary_max", "posted_within_days"]
RENAMED = {"exclude_title_keywords": "exclude_keywords", "job_functions": "families"}
MAX_LIMIT, DEFAULT_LIMIT = 5000, 100


def _strings(value) -> list[str]:
    if value is None:
        return []
    items = value if isinstance(value, (list, tuple, set)) else [value]
    return [s for s in (str(v).strip() for v in items if v is not None) if s]


def _number(value):
    if value is None or value == "" or isinstance(value, bool) and not value:
        return None
    try:
        n = float(value)
    except (TypeError, ValueError):
        return None
    return n if math.isfinite(n) else None


def normalize_profile(raw: dict | None = None) -> tuple[dict, list[str]]:
    """A complete profile and the warnings about what was ignored.

    Unset criteria are inactive; unknown enum members are dropped and named, and
    unknown keys survive under ``extra``.
    """
    raw, warnings, p = dict(raw or {}), [], {}
    p["name"] = str(raw.get("name") or "untitled").strip() or "untitled"
    p["label"], p["notes"] = raw.get("label"), raw.get("notes")
    p["text"] = str(raw.get("text") or "").strip()

    def warn(field: str, lost: list[str]) -> None:
        if lost:
            warnings.append(f"{field}: ignored unknown value{'s' if len(lost) > 1 else ''} {', '.join(lost)}")

    for field, (allowed, shape) in LIST_FIELDS.items():
        given = [shape(v) for v in _strings(raw.get(field, raw.get(RENAMED.get(field, field))))]
        kept = given if allowed is None else [v for v in dict.fromkeys(given) if v in allowed]
        if allowed is not None:
            warn(field, [v for v in given if v not in kept])
        p[field] = kept
    codes = [v.upper() for v in _strings(raw.get("currencies"))]
    p["currencies"] = [c for c in codes if re.fullmatch("[A-Z]{3}", c)]
    warn("currencies", [c for c in codes if c not in p["currencies"]])
    if _strings(raw.get("exclude_companies")):
        warnings.append("exclude_companies: companies can not be excluded; these entries are ignored")
    for field, options in CHOICES.items():
        p[field] = raw.get(field) if raw.get(field) in options else options[0]
    for field in FLAGS:
        p[field] = bool(raw.get(field))
    for field in NUMBERS:
        p[field] = _number(raw.get(field))
    visa = raw.get("requires_visa_sponsorship")
    p["requires_visa_sponsorship"] = None if visa is None else bool(visa)

    p["unknowns"] = dict.fromkeys(UNKNOWABLE_CRITERIA, "include")
    for key, policy in (raw.get("unknowns") or {}).items():
        if key not in p["unknowns"]:
            warnings.append(f'unknowns: ignored unknown criterion "{key}"')
        elif policy not in UNKNOWN_POLICIES:
            warnings.append(f'unknowns.{key}: "{policy}" is not one of {" / ".join(UNKNOWN_POLICIES)}')
        else:
            p["unknowns"][key] = policy
    p["weights"] = dict(DEFAULT_WEIGHTS)
    for key, value in (raw.get("weights") or {}).items():
        if key in DEFAULT_WEIGHTS and _number(value) is not None:
            p["weights"][key] = _number(value)
    p["sort"] = raw.get("sort") if raw.get("sort") in SORTS else "relevance"
    if raw.get("sort") is not None and raw["sort"] != p["sort"]:
        warnings.append(f'sort: "{raw["sort"]}" is not one of {" / ".join(SORTS)}; using {p["sort"]}')
    limit = _number(raw.get("limit"))
    p["limit"] = int(max(1, min(DEFAULT_LIMIT if limit is None else limit, MAX_LIMIT)))
    if limit is not None and limit > MAX_LIMIT:
        warnings.append(f"limit: a page holds at most {MAX_LIMIT} rows; use offset for the rest")
    extra = {k: v for k, v in raw.items() if k not in p and k not in RENAMED.values() and k != "exclude_companies"}
    if extra:
        p["extra"] = extra
    return p, warnings


def allowed_seniority(p: dict) -> list[str] | None:
    """The bands a search admits: those listed, else those its years limits admit; None when inactive."""
    if p["seniority"]:
        return p["seniority"]
    lowest, highest = p["min_years_experience"], p["max_years_experience"]
    if lowest is None and highest is None:
        return None
    return [
        band for band in SENIORITY_LEVELS
        if band in BAND_FLOOR
        and (band != "intern" or p["include_intern"])
        and (highest is None or BAND_FLOOR[band] <= highest)
        and (lowest is None or BAND_CEILING.get(band, math.inf) >= lowest)
    ]
