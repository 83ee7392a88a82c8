"""Scalar column functions over posting and board fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SECTORS
from .countries import COUNTRY_NAMES
from .text import trim_space, trimmed


def country_name(code: Column) -> Column:
    """Name of a two-letter code; anything else is NULL."""
    text = "\n".join(f"{k}\t{v}" for k, v in COUNTRY_NAMES.items())
    table = F.str_to_map(F.lit(text), F.lit("\n"), F.lit("\t"))
    return F.try_element_at(table, F.upper(F.trim(code)))


def company_id(ats: Column, slug: Column) -> Column:
    return F.concat_ws(":", ats, slug)


def job_id(ats: Column, slug: Column, native: Column) -> Column:
    return F.concat_ws(":", ats, slug, native)


def to_epoch(c: Column) -> Column:
    """ISO date or date-time to a UTC timestamp, NULL when unreadable."""
    return F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")))


def age_days(posted_at: Column, now: Column) -> Column:
    days = F.floor((F.unix_millis(now) - F.unix_millis(posted_at)) / 86_400_000 + 0.5)
    return F.when(days < 0, 0).otherwise(days)


# Employment words and the type each one names.
COMMITMENTS = [
    ("\\b(?:full[\\s-]*time|fulltime)\\b", "FullTime"), ("\\b(?:part[\\s-]*time|parttime)\\b", "PartTime"),
    ("\\b(?:contract|contractor|freelance|freelancer)\\b", "Contract"),
    ("\\b(?:temporary|temp|seasonal|fixed[\\s-]*term)\\b", "Temporary"),
    ("\\b(?:intern|internship|trainee|apprentice|co[\\s-]*op)\\b", "Intern"), ("\\b(?:volunteer|voluntary)\\b", "Volunteer"),
]


def employment_type_from_commitment(c: Column) -> Column:
    """A type only when exactly one kind of word occurs."""
    hits = F.filter(F.array(*[F.when(c.rlike(f"(?i){p}"), F.lit(t)) for p, t in COMMITMENTS]), lambda t: t.isNotNull())
    return F.when(F.size(hits) == 1, hits[0])


def employment_type_from_time_type(c: Column) -> Column:
    word = F.regexp_replace(F.lower(c), "[\\s_-]+", "")
    return F.when(word == "fulltime", "FullTime").when(word == "parttime", "PartTime")


def pay_interval_words(c: Column) -> Column:
    """Interval from words such as ``1 YEAR``; NONE when nothing is named."""
    text, out = F.upper(F.coalesce(c, F.lit(""))), None
    for needle, name in (("YEAR", "YEAR"), ("6 MONTH", "HALF_YEAR"), ("MONTH", "MONTH"), ("WEEK", "WEEK"), ("DAY", "DAY"), ("HOUR", "HOUR")):
        hit = text.contains(needle)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("NONE")


# Interval codes of one source.
INTERVAL_CODES = {
    "per-year-salary": "YEAR", "per-month-salary": "MONTH", "semi-month-salary": "SEMI_MONTH", "bi-week-salary": "BIWEEK",
    "per-week-salary": "WEEK", "per-day-wage": "DAY", "per-hour-wage": "HOUR", "one-time": "NONE",
}


def pay_interval_code(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in INTERVAL_CODES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(c)))


def positive(c: Column) -> Column:
    n = c.cast("double")
    return F.when((n > 0) & (n < float("inf")), n)


def real_place(c: Column) -> Column:
    """A place, not a count of places (``3 Locations``)."""
    text = trimmed(c)
    return F.when(~text.rlike("(?i)^\\d+\\s+locations?$"), text)


def distinct_places(*values: Column) -> Column:
    """Ordered distinct non-blank strings of strings and string arrays."""
    return F.array_distinct(F.filter(F.transform(F.concat(*values), trim_space), lambda p: p.isNotNull() & (p != "")))


def native_id_from_path(path: Column) -> Column:
    tail = F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(-1))
    return F.coalesce(F.try_url_decode(F.regexp_replace(tail, "\\+", "%2B")), tail)


def company_name_from_url(url: Column) -> Column:
    """Readable name out of a board's URL segment; NULL when it has no capital."""
    segment = F.regexp_extract(url, "myworkdayjobs\\.com/([^/]*)", 1)
    name = F.regexp_replace(segment, "([a-z0-9])([A-Z])", "$1 $2")
    name = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, "[_-]+", " "), "\\s+", " "))
    name = F.regexp_replace(name, "(?i)\\s+(external\\s+)?careers?$", "")
    name = F.trim(F.regexp_replace(name, "(?i)\\s+jobs$", ""))
    return F.when(segment.rlike("[A-Z]") & (F.length(name) > 1), name)


def parse_board_slug(c: Column) -> Column:
    """struct(tenant, dc, site) of ``tenant|dc|site``, NULL when malformed."""
    parts = F.transform(F.split(c, "[|]"), lambda p: F.trim(p))
    tenant, dc, site = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    ok = (
        (F.size(parts) == 3) & ~tenant.rlike("(?i)^wd\\d+$") & tenant.rlike("(?i)^[a-z0-9][a-z0-9-]*$")
        & dc.rlike("(?i)^wd\\d+$") & site.rlike("(?i)^[a-z0-9][a-z0-9_-]*$")
    )
    return F.when(ok, F.struct(tenant.alias("tenant"), dc.alias("dc"), site.alias("site")))


# Board URL shapes per system, slug alphabets and words that are never a slug.
BOARD_URLS = {
    "ashby": ["^https?://(?:www\\.)?jobs\\.ashbyhq\\.com/([^/?#]+)", "^https?://api\\.ashbyhq\\.com/posting-api/job-board/([^/?#]+)"],
    "greenhouse": [
        "^https?://boards-api\\.greenhouse\\.io/v1/boards/([^/?#]+)",
        "^https?://(?:job-)?boards(?:\\.eu)?\\.greenhouse\\.io/embed/job_board\\?for=([^/?#&]+)",
        "^https?://(?:job-)?boards(?:\\.eu)?\\.greenhouse\\.io/([^/?#]+)",
    ],
    "lever": ["^https?://api\\.lever\\.co/v0/postings/([^/?#]+)", "^https?://jobs\\.(?:eu\\.)?lever\\.co/([^/?#]+)"],
    "workday": ["^https?://([^./]+)\\.(?:wd\\d+\\.)?myworkdayjobs\\.com"],
    "bamboohr": ["^https?://([^./]+)\\.bamboohr\\.com"],
    "smartrecruiters": ["^https?://(?:api|careers|jobs)\\.smartrecruiters\\.com/([^/?#]+)"],
    "workable": ["^https?://(?:apply|jobs|www)\\.workable\\.com/(?:api/v1/accounts/)?([^/?#]+)"],
    "recruitee": ["^https?://([^./]+)\\.recruitee\\.com"],
    "teamtailor": ["^https?://([^./]+)\\.teamtailor\\.com"],
}
SLUG_PATTERNS = {"ashby": "^[a-z0-9][a-z0-9._ -]*$", "workday": "^[a-z0-9][a-z0-9._|-]*$"}
DEFAULT_SLUG_PATTERN = "^[a-z0-9][a-z0-9._-]*$"
NEVER_A_SLUG = [
    "null", "undefined", "none", "test", "example", "demo", "localhost", "www", "api", "jobs", "careers", "search", "index",
    "robots.txt", "sitemap.xml", "favicon.ico",
]
MAX_SLUG = 120


def normalize_slug(c: Column, ats: str) -> Column:
    """Board slug from a raw list entry or URL; NULL when it can not be one."""
    raw = trimmed(c)
    tries = [F.nullif(F.regexp_extract(raw, f"(?i){p}", 1), F.lit("")) for p in BOARD_URLS.get(ats, [])]
    value = F.when(raw.rlike("(?i)^https?://"), F.coalesce(*tries, F.lit(None).cast("string"))).otherwise(raw)
    value = F.regexp_replace(F.lower(value), "^/+|/+$", "")
    value = trim_space(F.regexp_replace(value, "\\?.*$", ""))
    value = F.substring_index(value, "/", 1)
    # A plus sign is a plus sign here, not a space.
    value = F.coalesce(F.try_url_decode(F.regexp_replace(value, "\\+", "%2B")), value)
    value = F.trim(F.regexp_replace(value, "\\s+", " "))
    ok = F.length(value).between(1, MAX_SLUG) & value.rlike(SLUG_PATTERNS.get(ats, DEFAULT_SLUG_PATTERN)) & ~value.isin(NEVER_A_SLUG)
    return F.when(ok, value)


def external_job_url(careers_url: Column, native_id: Column) -> Column:
    """Deep link into a company's own careers page."""
    joiner = F.when(careers_url.contains("?"), "&").otherwise("?")
    encoded = F.regexp_replace(F.url_encode(native_id), "\\+", "%20")
    return F.concat(careers_url, joiner, F.lit("ashby_jid="), encoded)


# Headings that open the part of a posting about the company.
ABOUT_HEADINGS = [
    "about us", "about the company", "about the team", "who we are", "our mission", "company overview", "the company",
    "our story", "what we do", "why join",
]
EXCERPT_CHARS = 1500
BLURB_CHARS = 180


def about_excerpt(text: Column, name: Column, chars: int = EXCERPT_CHARS) -> Column:
    """Up to ``chars`` characters from the first company heading, else from the start."""
    own = F.when(F.length(name) >= 3, F.concat(F.lit("about "), F.regexp_replace(name, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1"), F.lit("|"))).otherwise("")
    pattern = F.concat(F.lit("(?i)(^|\\n)[ \\t]*(?:"), own, F.lit("|".join(ABOUT_HEADINGS)), F.lit(")[ \\t]*[:\\-–—]?[ \\t]*(?:\\n|$)"))
    at = F.regexp_instr(text, pattern)
    start = F.when(at <= 0, 1).when(F.substring(text, at, F.lit(1)) == "\n", at + 1).otherwise(at)
    cut = F.substring(text, start, F.lit(chars))
    return trim_space(F.regexp_replace(F.regexp_replace(cut, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def clean_verdict(sector: Column, blurb: Column, confidence: Column) -> Column:
    """struct(sector, blurb, confidence): a sector only from the list and not on low confidence; one tidy sentence."""
    level = F.when(confidence.isin("high", "medium", "low"), confidence).otherwise("low")
    name = F.lower(F.trim(sector))
    kept = F.when(name.isin(list(SECTORS)) & (level != "low"), name)
    text = F.trim(F.regexp_replace(F.coalesce(blurb, F.lit("")), "\\s+", " "))
    text = F.regexp_replace(text, "^[\"'“”]+|[\"'“”]+$", "")
    text = F.trim(F.regexp_replace(text, "(?i)^blurb:\\s*", ""))
    cut = F.substring(text, 1, BLURB_CHARS)
    last_space = F.length(cut) - F.locate(" ", F.reverse(cut))
    kept_to = F.when(F.locate(" ", cut) == 0, -1).otherwise(last_space)
    short = F.concat(F.regexp_replace(F.substring(cut, F.lit(1), F.greatest(kept_to, F.lit(60))), "[,;:\\-–—]$", ""), F.lit("…"))
    text = F.when(F.length(text) > BLURB_CHARS, short).otherwise(text)
    text = F.when((text != "") & ~text.rlike("[.!?…]$"), F.concat(text, F.lit("."))).otherwise(text)
    return F.struct(kept.alias("sector"), F.nullif(text, F.lit("")).alias("blurb"), level.alias("confidence"))
